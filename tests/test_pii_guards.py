"""Personal data is found alike with and without the checks that spare texts the patterns."""

from pyspark.sql import functions as F

from cordon.functions import text as t
from cordon.refdata import fixed as V


def test_guards_change_no_text(spark):
    texts = [None, "", "no data here", "mail a.b@c.de", "mail@", "call +48 600 123 456", "both x@y.pl and 22 123 45 67", "ABC 123456", "id 12345678901", "١٢٣٤٥٦٧٨٩٠١", "٣@x.pl", "at @ alone 7", "PL12 1234 1234 1234 1234"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    plain, found = F.col("text"), F.lit(False)
    for kind in ("phone", "email", "pesel", "nip", "card", "iban"):
        plain = F.regexp_replace(plain, t.U + V.PII[kind][0], V.PII[kind][1])
    for kind in ("phone", "email", "pesel"):
        found = found | F.col("text").rlike(t.U + V.PII[kind][0])
    for r in rows.select("id", t.scrub_pii("text").alias("a"), plain.alias("b"), t.has_pii("text").alias("c"), F.coalesce(found, F.lit(False)).alias("d")).collect():
        assert r["a"] == r["b"] and r["c"] == r["d"], texts[r["id"]]


def test_texts_without_digits_are_spared_the_slow_patterns(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(t.scrub_pii("text").alias("a"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN RLIKE(text" in plan.replace("`", "") and "contains(" in plan.lower()

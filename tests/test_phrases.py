"""The phrase kernel against a naive scan."""

import random

from pyspark.sql import functions as F

from cordon.functions import phrases
from cordon.functions.phrases import occurring
from cordon.operators import enrich as e
from cordon.operators import filters as f
from cordon.refdata import terms as W
from cordon.refdata.tables import literal


def dictionary(r, langs, per_lang):
    parts = ["ab", "ba", "ż", "é", " ", "c", "пр", "x-"]
    out = []
    for lang in langs:
        for i in range(per_lang):
            word = "".join(r.choice(parts) for _ in range(r.randrange(1, 6)))
            out.append((f"g{i % 7}", i % 7, lang, word.upper() if i % 5 == 0 else word, i))
    return out


def test_equals_naive_scan(spark, monkeypatch):
    r = random.Random(1)
    langs = [f"l{i}" for i in range(25)]
    rows = dictionary(r, langs, 40) + [("g0", 0, "l1", None, 99), ("g1", 1, None, "ab", 100), ("g2", 2, "l2", "", 101)] * 2
    terms = literal(spark, rows, W.SCHEMA)
    texts = [(i, "".join(r.choice(["ab", "BA", "ż", "É", " ", "c", "Пр", "x-", "q"]) for _ in range(r.choice([0, 3, 40, 2000]))), r.choice([*langs, None, "zz"])) for i in range(60)] + [(99, None, "l1")]
    df = spark.createDataFrame(texts, "i long, text string, lang string").repartition(3)
    want = {}
    for i, text, _ in texts:
        hit = [(g, k, rank, lang, (w or "").lower()) for g, k, lang, w, rank in rows if text is not None and w is not None and w.lower() in text.lower()]
        want[i] = sorted(hit, key=str)
    for part in (1 << 24, 600):  # one automaton, then several
        monkeypatch.setattr(phrases, "PART_BYTES", part)
        got = phrases.in_terms(df, terms, F.col("text"), "hits").collect()
        assert {x["i"]: sorted(((h["grp"], h["grp_rank"], h["rank"], h["lang"], h["keyword"]) for h in x["hits"]), key=str) for x in got} == want
        assert all([tuple(h)[:2] for h in x["hits"]] == sorted(tuple(h)[:2] for h in x["hits"]) for x in got)
    # without the automaton package
    monkeypatch.setattr(phrases, "ahocorasick", None)
    automaton = phrases.Automaton(["ab", "", None, "b"], None)
    assert automaton.found("xab") == [0, 1, 3] and automaton.found("") == [1]


def test_empty_dictionary(spark):
    df = spark.createDataFrame([(1, "Text", "en"), (2, None, None)], "i long, text string, lang string")
    none = literal(spark, [], W.SCHEMA)
    assert [x["hits"] for x in phrases.in_terms(df, none, F.col("text"), "hits").collect()] == [[], []]
    assert [x["is_transport"] for x in f.is_transport(df, none, none, F.col("text"), "lang").collect()] == [False, False]
    assert [x["event_type"] for x in e.classify_type(df, none, F.col("text"), "lang").collect()] == ["other", "other"]


def test_multilingual_road_alerts_and_tags(spark):
    texts = [(1, "Stau auf der A2, Unfall", "de"), (2, "Zamknięta droga, OBJAZD i wypadek", "pl"), (3, "Пробка на трассе", "ru"), (4, "Nothing here", "xx"), (5, "Road closed: ICE", "xx"), (6, "Stau", "en")]
    df = spark.createDataFrame(texts, "i long, text string, lang string")
    road = W.by_language(spark, "road_alert", W.ROAD_ALERT_TERMS)
    got = e.road_alert_type(f.is_road_alert(df, road, F.col("text"), "lang"), W.terms(spark, ("*", W.ALERT_TYPE_TERMS)), F.col("text")).orderBy("i").collect()
    assert [x["is_road_alert"] for x in got] == [True, True, True, False, True, False]
    assert [x["alert_type"] for x in got] == ["traffic_jam", "road_closed", "traffic_jam", "other", "road_closed", "traffic_jam"]
    tags = e.tags(df.limit(0).unionByName(spark.createDataFrame([(1, "Nachts am Rastplatz: Laptop und Tabak", "de")], df.schema)), W.terms(spark, ("*", W.TAG_TERMS)), F.col("text")).first()["tags"]
    assert tags == ["nocna", "parking", "elektronika", "tytoń"]


def test_many_places(spark):
    """A gazetteer of 100,000 names: the first that stands as a whole word."""
    rows = [(f"town{i}", f"town{i}", "XX", f"r{i % 9}", i) for i in range(100_000)] + [("los", "los", "YY", "r", -1)]
    ref = literal(spark, rows, "key string, city string, country string, region string, rank int")
    df = spark.createDataFrame([(1, "from Town70001 to town12, closed", None), (2, "xtown5 town5x losing", "DE"), (3, None, None), (4, "A2: TOWN99999!", "DE")], "i long, text string, country_code string")
    got = e.extract_place(df, ref, F.col("text")).orderBy("i").collect()
    assert [x["city"] for x in got] == ["Town12", None, None, "Town99999"]
    assert [x["country_code"] for x in got] == ["XX", "DE", None, "DE"] and got[3]["road"] == "A2"


def test_first_whole_place_is_found_without_listing_the_rest(spark):
    """Few entries reach the check of word edges, and the first whole one is that of a search by Java's edges alone."""
    keys = ["a", "ab", "b", "b.", ".b", "é", "b\u0301", "ⓐ", "a ⓐ", "-", "0a", "_", ""]
    rows = [(k, k, "XX", "r", i) for i, k in enumerate(keys)]
    texts = ["ab", "a-b", "xab ab", "b.b", " .b", "eé é", "b\u0301 b", "ⓐ", "bⓐ a ⓐ", "-", "x-y", "0a", "a_b", "", "ab\u200db", "a²b", "_", "éb b."]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "i long, text string, country_code string")
    for order in (rows, [(*r[:4], -r[4]) for r in rows]):
        ref = literal(spark, order, "key string, city string, country string, region string, rank int")
        naive = df.crossJoin(ref).where(F.regexp_like("text", F.concat(F.lit(r"(?U)\b\Q"), "key", F.lit(r"\E\b")))).groupBy("i").agg(F.min_by("key", "rank").alias("k"))
        want = {r["i"]: r["k"] for r in naive.collect()}
        got = {r["i"]: r["k"] for r in e.extract_place(df.withColumn("region", F.lit(None)), ref.withColumn("region", F.col("key")), F.col("text")).select("i", F.col("region").alias("k")).collect()}
        assert got == {i: want.get(i) for i in range(len(texts))}
    many = literal(spark, [(f"w{i}", f"w{i}", "XX", "r", i) for i in range(500)], "key string, city string, country string, region string, rank int")
    text = spark.createDataFrame([(" ".join(f"w{i}" for i in range(499, -1, -1)),)], "text string")
    assert occurring(text, many.select("rank", "key"), "key", "text", "near", first_whole=True).select(F.size("near")).first()[0] == 1


def test_python_gets_texts_in_batches_of_bounded_bytes(spark):
    """However many rows a task has: 4,000 pages of 10 KB in one split."""
    import pyarrow as pa

    from cordon.session import BATCH_BYTES, _bytes
    from cordon.sources import pages

    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch")}
    try:
        for make in (lambda d: pages.page_items(d), lambda d: occurring(d, literal(spark, [("news",)], "keyword string"), "keyword", "html", "hits")):
            for k, v in old.items():
                spark.conf.set(k, v)
            df = spark.range(4000, numPartitions=1).selectExpr("id as page_id", "'u' as url", "concat('<article><h2>News title</h2>', repeat('x', 10000), '</article>') as html")
            made = make(df)
            assert made.count() == 4000
            seen = df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
            assert max(r[0] for r in seen.collect()) <= 2 * BATCH_BYTES
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [_bytes(x) for x in ("-1", "64mb", "2097152", "1k", "3b")] == [-1, 64 << 20, 2 << 20, 1024, 3]

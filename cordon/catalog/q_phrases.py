"""Dictionaries at length: the shipped multilingual ones, and ones of thousands of entries that Spark derives from
the documents themselves, against naive scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import L, values
from cordon.catalog.registry import query
from cordon.operators import enrich as e
from cordon.operators import filters as f
from cordon.refdata import fixed as V
from cordon.refdata import terms as W

ROAD = [r for lang, words in W.ROAD_ALERT_TERMS.items() for r in W.rows_of({"road_alert": words}, lang)]
KIND = W.rows_of(W.ALERT_TYPE_TERMS, "*")
TAGS = W.rows_of(W.TAG_TERMS, "*")
VIEWS = {name: values(rows, "grp, g, lang, kw, r") for name, rows in (("road_term", ROAD), ("kind_term", KIND), ("tag_full", TAGS))}


def docs(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", "text", "lang")


@query("road_alerts_shipped", "F16,T24", """WITH d AS (SELECT doc_id, lower(text) AS x, CASE WHEN lang IN (SELECT lang FROM road_term) THEN lang ELSE 'en' END AS l FROM documents),
  h AS (SELECT doc_id, grp, g, count(DISTINCT kw) AS n FROM d JOIN kind_term ON contains(x, kw) GROUP BY 1, 2, 3), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) = 1)
  SELECT d.doc_id, EXISTS (SELECT 1 FROM road_term r WHERE r.lang = d.l AND contains(d.x, r.kw)) AS is_road_alert, coalesce(b.grp, 'other') AS alert_type FROM d LEFT JOIN b ON b.doc_id = d.doc_id""", VIEWS)
def _(spark, sf):
    d = f.is_road_alert(docs(spark, sf), W.by_language(spark, "road_alert", W.ROAD_ALERT_TERMS), F.col("text"), "lang")
    return e.road_alert_type(d, W.terms(spark, ("*", W.ALERT_TYPE_TERMS)), F.col("text")).select("doc_id", "is_road_alert", "alert_type")


@query("tags_shipped", "T20", """SELECT d.doc_id, coalesce(string_agg(grp, ',' ORDER BY g), '') AS tags FROM documents d LEFT JOIN (SELECT DISTINCT d.doc_id, k.grp, k.g FROM documents d JOIN tag_full k ON contains(lower(d.text), k.kw)) h ON h.doc_id = d.doc_id GROUP BY 1""", VIEWS)
def _(spark, sf):
    return e.tags(docs(spark, sf), W.terms(spark, ("*", W.TAG_TERMS)), F.col("text")).select("doc_id", "tags")


TYPES = [t for t in V.EVENT_TYPES if t != "other"]
#: Every word of six letters or more that stands in three documents of a language, its type by its length.
DERIVED = f"""derived AS (SELECT {L(TYPES)}[1 + length(kw) % {len(TYPES)}] AS grp, length(kw) % {len(TYPES)} AS g, lang, kw FROM (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}{{6,}}'))) AS kw FROM documents)
  GROUP BY lang, kw HAVING count(*) >= 3)"""


def derived(spark, sf):
    words = docs(spark, sf).select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{6,})"), F.lit(1)))).alias("keyword"))
    n = F.length("keyword") % len(TYPES)
    kept = words.groupBy("lang", "keyword").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return kept.select(F.element_at(F.array(*map(F.lit, TYPES)), n + 1).alias("grp"), n.alias("grp_rank"), "lang", "keyword", F.lit(0).alias("rank"))


@query("classify_type_wide", "T18", f"""WITH {DERIVED}, d AS (SELECT doc_id, lang, lower(text) AS x FROM documents),
  h AS (SELECT d.doc_id, k.grp, k.g, sum(CASE WHEN k.lang = d.lang THEN 2 ELSE 1 END) AS s FROM d JOIN derived k ON (k.lang = d.lang OR k.lang = 'en') AND contains(d.x, k.kw) GROUP BY 1, 2, 3),
  b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, g) = 1) SELECT d.doc_id, coalesce(b.grp, 'other') AS event_type FROM d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(spark, sf):
    return e.classify_type(docs(spark, sf), derived(spark, sf), F.col("text"), "lang").select("doc_id", "event_type")


#: A gazetteer of every capitalised word of five letters or more, the rarest first.
PLACES = r"""place AS (SELECT lower(w) AS key, min(w) AS name, row_number() OVER (ORDER BY count(*), lower(w)) AS r FROM (SELECT unnest(list_distinct(regexp_extract_all(text, '\p{Lu}\p{Ll}{4,}'))) AS w FROM documents) GROUP BY lower(w))"""


@query("extract_place_wide", "T2,G4", rf"""WITH {PLACES}, t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS w FROM documents),
  b AS (SELECT t.doc_id, p.key, p.r FROM t JOIN place p ON p.key = t.w QUALIFY row_number() OVER (PARTITION BY t.doc_id ORDER BY p.r) = 1)
  SELECT d.doc_id, b.key AS city_key, 'R' || CAST(b.r % 10 AS VARCHAR) AS region FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(spark, sf):
    words = docs(spark, sf).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}{4,})"), F.lit(1)))).alias("w"))
    counted = words.groupBy(F.lower("w").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("city"))
    ref = counted.rdd.map(tuple).sortBy(lambda r: (r[1], r[0].encode())).zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    ref = spark.createDataFrame(ref, "key string, n long, city string, rank long").selectExpr("key", "city", "'XX' as country", "concat('R', rank % 10) as region", "rank")
    d = docs(spark, sf).select("doc_id", "text", F.lit(None).cast("string").alias("country_code"))
    return e.extract_place(d, ref, F.col("text")).select("doc_id", F.lower("city").alias("city_key"), "region")

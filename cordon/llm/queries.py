"""The registered queries of the operators, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import conversation_sql, jaccard, katz, language, maxscore, mixing, prefix_trie, quality, repair, repeats, revisits, rules, secrets, sentence_pieces
from cordon.llm.text import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_classifier(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(documents(spark, sf_dir).select("doc_id", "text"), labels, keep_text=False).select("doc_id", "held_out", "score", "predicted")


@register
def op2_katz_backoff(spark, sf_dir):
    return katz.score(documents(spark, sf_dir).select("doc_id", "text"))


@register
def op3_secret_scan(spark, sf_dir):
    return secrets.digests(documents(spark, sf_dir))


@register
def op4_revisit_resolution(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = revisits.resolve(revisits.captures(pages))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return out.select(F.col("record_id").alias("page_id"), "canonical_url", "state", F.col("refers_to").cast("string").alias("refers_to"), "digest", F.col("length").cast("string").alias("length"), headers.alias("headers"))


@register
def op5_sentence_pieces(spark, sf_dir):
    return sentence_pieces.round_trip(documents(spark, sf_dir), sentence_pieces.model_bytes())


@register
def op6_quality_rules(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return rules.judge(documents(spark, sf_dir).select("doc_id", "text", "lang"), labels)


@register
def op7_jaccard_join(spark, sf_dir):
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@register
def op8_maxscore_top20(spark, sf_dir):
    vectors = maxscore.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return maxscore.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@register
def op9_language_id(spark, sf_dir):
    return language.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"), keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@register
def op10_source_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


@register
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@register
def op12_suffix_dedup(spark, sf_dir):
    return repeats.removed(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register
def op13_structure_repair(spark, sf_dir):
    return repair.audits(repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@register
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

ORACLES["op11_prefix_trie"] = conversation_sql.PREFIX_TRIE
ORACLES["op13_structure_repair"] = conversation_sql.REPAIR

ORACLES["op8_maxscore_top20"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

ORACLES["op10_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(concat_ws('|', 'mix', doc_id::VARCHAR)) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
f AS (SELECT *, sum(n) OVER ()::BIGINT AS total, (sum(2 * n) OVER before)::BIGINT AS caps, (sum(w) OVER after)::BIGINT AS rest FROM s
      WINDOW before AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             after AS (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, w * (3 * total - 2 * coalesce(caps, 0)) > 4 * n * rest AS over FROM f),
h AS (SELECT *, 3 * total - 4 * coalesce((SELECT sum(n) FROM g WHERE over)::BIGINT, 0) AS remaining, coalesce((SELECT sum(w) FROM g WHERE NOT over)::BIGINT, 1) AS free FROM g),
t AS (SELECT source AS src, n, CASE WHEN over THEN (2 * n)::DOUBLE ELSE (w * remaining)::DOUBLE / (2 * free)::DOUBLE END AS target FROM h),
u AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS whole FROM t),
k AS (SELECT *, round(target - whole * n)::BIGINT AS need FROM u),
e AS (SELECT d.*, k.n, k.target, k.whole, k.need, substr(o, 1, 3) AS b, (sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.src),
m AS (SELECT *, min(CASE WHEN upto >= need THEN b END) OVER (PARTITION BY source) AS edge FROM e),
p AS (SELECT *, (whole + CASE WHEN whole < 2 AND (edge IS NULL OR b < edge OR (b = edge AND size > 0 AND 2 * (upto - need) <= size)) THEN 1 ELSE 0 END)::INT AS repeats FROM m)
SELECT doc_id, source, size, n AS source_size, target, repeats, (size * repeats)::BIGINT AS taken FROM p"""

_FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES["op7_jaccard_join"] = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
      UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

ORACLES["op4_revisit_resolution"] = r"""
WITH s AS (SELECT page_id, html, regexp_extract(lower(url), '^([a-z]+://[^/?#]*/?[^/?#]*)', 1) AS site, page_id % 3 = 0 AS revisit, (page_id // 7) % 2 AS version FROM pages),
c AS (SELECT *, CASE WHEN page_id % 11 <> 0 THEN '"' || left(md5(site), 8) || '-' || version::VARCHAR || '"' END AS etag,
      regexp_replace(regexp_replace(regexp_replace(site, '^[a-z]+://', ''), '^www\d*\.', ''), '/+$', '') AS plain,
      strftime(make_timestamp(1700000000000000 + page_id * 1000000), '%Y-%m-%d %H:%M:%S') AS date,
      CASE WHEN NOT revisit THEN sha256(html) END AS digest, CASE WHEN NOT revisit THEN length(html)::BIGINT END AS length, coalesce(length(html), 0)::VARCHAR AS size FROM s),
k AS (SELECT *, CASE WHEN plain <> '' THEN regexp_replace(plain, '^([^/]*):(80|443)(/|$)', '\1\3') END AS canonical_url FROM c),
f AS (SELECT page_id, canonical_url, etag, version, digest, length, size FROM k WHERE digest IS NOT NULL AND canonical_url IS NOT NULL),
j AS (SELECT k.*, f.page_id AS from_id, f.etag AS from_etag, f.version AS from_version, f.digest AS from_digest, f.length AS from_length, f.size AS from_size
      FROM k ASOF LEFT JOIN f ON k.canonical_url = f.canonical_url AND k.page_id > f.page_id),
d AS (SELECT *, CASE WHEN canonical_url IS NULL OR (NOT revisit AND digest IS NULL) THEN 'other' WHEN NOT revisit THEN 'full' WHEN from_id IS NULL THEN 'orphan'
      WHEN CASE WHEN etag IS NOT NULL AND from_etag IS NOT NULL THEN etag = from_etag ELSE version = from_version END THEN 'resolved' ELSE 'conflict' END AS state FROM j)
SELECT page_id, canonical_url, state, CASE state WHEN 'full' THEN page_id WHEN 'resolved' THEN from_id WHEN 'conflict' THEN from_id END::VARCHAR AS refers_to,
  CASE WHEN state = 'resolved' THEN from_digest ELSE digest END AS digest, (CASE WHEN state = 'resolved' THEN from_length ELSE length END)::VARCHAR AS length,
  'content-length=' || CASE WHEN state = 'resolved' THEN from_size ELSE size END || ';content-type=text/html;date=' || date || ';etag=' || coalesce(etag, '') AS headers FROM d"""

ORACLES["op6_quality_rules"] = r"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
q AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n FROM g, (SELECT unnest(range(0, 5)) AS j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(q.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN q USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
v AS (SELECT *, unnest(CASE WHEN n_words > 0 THEN [n_symbols / n_words, n_dup_lines / n_lines, n_repeat_words / n_words, word_chars / n_words, -word_chars / n_words] ELSE [0.0, 0.0, 0.0, 0.0, -1e9] END) AS value, unnest(range(1, 6)) AS rule FROM b),
o AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
h AS (SELECT * FROM (SELECT unnest(range(1, 6)) AS rule, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'word_length', 'short_word_length']) AS name,
      unnest([[0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0], [0.1, 0.2, 0.3, 0.5, 0.7], [0.02, 0.05, 0.1, 0.15], [7.0, 8.0, 9.0, 10.0, 12.0, 15.0], [-4.5, -4.0, -3.5, -3.0, -2.5]]::DOUBLE[][]) AS cs)),
cuts AS (SELECT rule, unnest(cs) AS cutoff FROM h),
k AS (SELECT v.lang, c.rule, c.cutoff, count(*) AS n, count_if(v.value > c.cutoff)::BIGINT AS k FROM v JOIN cuts c USING (rule) WHERE NOT base_failed AND doc_id IN (FROM o) GROUP BY 1, 2, 3),
proven AS (SELECT lang, rule, min(cutoff) AS cutoff FROM k WHERE k < 0.01 * n
  AND list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) for i in range(0, k + 1)]) <= 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM k)) * (SELECT count(*) FROM cuts)) GROUP BY 1, 2),
z AS (SELECT v.doc_id, string_agg(h.name, ',' ORDER BY v.rule) AS failed_rules FROM v JOIN proven p ON p.lang IS NOT DISTINCT FROM v.lang AND p.rule = v.rule AND v.value > p.cutoff JOIN h ON h.rule = v.rule GROUP BY v.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND z.doc_id IS NULL AS kept, coalesce(failed_rules, '') AS failed_rules FROM b LEFT JOIN z USING (doc_id)"""

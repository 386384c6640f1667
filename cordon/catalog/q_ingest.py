"""Raw contract, gates, ingest chain, sinks, feeds, pages, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import ts
from cordon.catalog.q_text import TIERW, mask_sql, neutral_sql, scrub_sql
from cordon.catalog.registry import query
from cordon.operators import gates as g
from cordon.operators import joins as j
from cordon.plans import ingest as ing
from cordon.refdata import fixed as V
from cordon.refdata import terms as W
from cordon.refdata.tables import literal
from cordon.sources import feeds, pages, registries
from cordon.sources import ingest_rows as ir
from cordon.sources import road_alerts as ra


def raw_docs(spark, sf):
    """Documents as raw articles; the first line is the title."""
    d = B.table(spark, sf, "documents")
    return d.selectExpr(
        "doc_id", "concat('https://', source, case doc_id % 9 when 7 then '.facebook.com' when 8 then '' else '.example.org' end, '/', cast(doc_id as string)) as url0",
        "case when doc_id % 20 = 19 then null when doc_id % 9 = 8 then 'https://www.facebook.com/x' else concat('https://', source, '.example.org/', cast(doc_id as string)) end as source_url",
        "source as source_name", "substring_index(text, '\\n', 1) as title", "text as description", "cast(null as string) as raw_text",
        "case doc_id % 4 when 0 then 'police' when 1 then 'forum' else 'news' end as source_type", "'' as date", "case when doc_id % 25 = 3 then null else '2024-01-10T08:00:00' end as timestamp",
        "cast(null as string) as country_code", "lang as language", "(doc_id % 10) / 10.0D as trust_score", "doc_id % 4 = 0 as is_official", "cast(null as string) as collected_at",
    ).drop("url0")


@query("validate_raw", "S2", """SELECT doc_id, CASE WHEN s.s_suppkey IS NOT NULL THEN ['PL', 'DE', 'FR', 'NL', 'AT', 'CZ', 'RO', 'HU', 'IT', 'ES'][s.s_suppkey % 10 + 1] END AS country_code FROM documents d LEFT JOIN supplier s ON d.source = 'src' || CAST(s.s_suppkey AS VARCHAR) WHERE doc_id % 20 <> 19 AND text <> ''""")
def _(spark, sf):
    ref = B.table(spark, sf, "supplier").selectExpr("concat('src', cast(s_suppkey as string)) as source_name", f"{B.pick(B.CCS, 's_suppkey % 10')} as country_code", "'en' as language", "'news' as source_type", "0.5D as trust_score", "false as is_official")
    return ir.validate_raw(raw_docs(spark, sf), ref).select("doc_id", "country_code")


@query("flatten_catalogue", "S3", """SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS name, 'http://f/' || CAST(s_suppkey AS VARCHAR) AS url, 0.5::DOUBLE AS trust_score, false AS is_official, 'news' AS source_type, CASE WHEN s_suppkey % 2 = 0 THEN 'de' ELSE 'pl' END AS language, CAST(s_nationkey AS VARCHAR) AS country_code FROM supplier WHERE s_suppkey % 3 > 0
  UNION ALL SELECT 'p' || CAST(s_suppkey AS VARCHAR), 'http://p/' || CAST(s_suppkey AS VARCHAR), 0.9, true, 'police', 'pl', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def _(spark, sf):
    feed = "named_struct('name', concat('f', cast(s_suppkey as string)), 'url', case when s_suppkey % 3 > 0 then concat('http://f/', cast(s_suppkey as string)) else 'placeholder' end, 'trust_score', cast(null as double), 'is_official', cast(null as boolean), 'language', case when s_suppkey % 2 = 0 then 'de' end)"
    police = "named_struct('name', concat('p', cast(s_suppkey as string)), 'url', concat('http://p/', cast(s_suppkey as string)), 'trust_score', 0.9D, 'is_official', true, 'language', cast(null as string))"
    cfg = B.table(spark, sf, "supplier").selectExpr("cast(s_nationkey as string) as country_code", "'pl' as language", f"map('news', array({feed}), 'police', array({police})) as feeds")
    return ir.flatten_catalogue(cfg)


def pii(x):
    return f"(regexp_matches({x}, '{V.PII['phone'][0]}') OR regexp_matches({x}, '{V.PII['email'][0]}') OR regexp_matches({x}, '{V.PII['pesel'][0]}'))"


def purged(x):
    return f"regexp_replace({scrub_sql(x)}, '{V.PII['plate'][0]}', '{V.PII['plate'][1]}', 'g')"


GDPR = f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t, text AS b, doc_id % 4 = 1 AS social, doc_id % 4 = 0 AS official FROM documents), f AS (SELECT *, {pii('t')} AS pt, {pii('b')} AS pb FROM d),
  g AS (SELECT *, (pt OR pb) AND social AS purge FROM f), h AS (SELECT *, purge AND ({pii(purged('t'))} OR {pii(purged('b'))}) AS rest FROM g)
  SELECT doc_id, CASE WHEN NOT pt AND NOT pb THEN 'compliant' WHEN rest THEN 'needs_review' WHEN purge THEN 'compliant' WHEN official THEN 'needs_review' ELSE 'non_compliant' END AS gdpr_status,
    concat_ws(',', CASE WHEN pt THEN 'title' END, CASE WHEN pb THEN 'description' END) AS gdpr_fields, CASE WHEN NOT pt AND NOT pb THEN 'none' WHEN purge THEN 'anonymized' WHEN official THEN 'none' ELSE 'rejected' END AS gdpr_action FROM h"""


@query("gdpr_gate", "F17", GDPR)
def _(spark, sf):
    return g.gdpr_gate(raw_docs(spark, sf)).select("doc_id", "gdpr_status", "gdpr_fields", "gdpr_action")


LEGAL = f"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 20 = 19 THEN 'no_source_url' WHEN doc_id % 25 = 3 THEN 'no_timestamp' END AS why, NOT (doc_id % 4 = 0 AND (doc_id % 10) / 10 >= 0.7) AS masked FROM documents),
  n AS (SELECT *, {neutral_sql('text')} AS fair FROM d) SELECT doc_id, why AS legal_reject, masked AS company_masked, md5(CASE WHEN why IS NOT NULL THEN text WHEN masked THEN {mask_sql('fair', "'firma transportowa z regionu nieznany'")} ELSE fair END) AS digest FROM n"""


@query("legal_gate", "F18", LEGAL)
def _(spark, sf):
    return g.legal_gate(raw_docs(spark, sf)).select("doc_id", "legal_reject", "company_masked", F.md5("description").alias("digest"))


@query("ingest", "F19")
def _(spark, sf):
    return ing.staged(raw_docs(spark, sf), ing.starter(spark)).select("doc_id", "event_type", "severity", "tags", "language", "date_parsed", "road", "gdpr_status", "reject_reason", F.md5("description").alias("digest"))


@query("ingest_linked", "F19,J3,G4,T21")
def _(spark, sf):
    """Stored rows with tier, coordinates and company, as clusters, risk and the publishing queue read them."""
    raw = raw_docs(spark, sf).withColumn("company_name", F.when(F.col("doc_id") % 3 > 0, F.format_string("CUSTOMER %09d", F.col("doc_id") % 200)))
    refs = ing.starter(spark)
    refs.tiers, refs.companies = literal(spark, TIERW, W.SCHEMA), B.companies(spark, sf)
    ok, _ = ing.ingest(raw, refs)
    return ok.select("doc_id", "event_type", "intelligence_tier", "intelligence_category", "city", "latitude", "longitude", "company_id")


@query("link_company", "J3,F19", """WITH q AS (SELECT req_id, nullif(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), '') AS k, country_code AS cc FROM request),
  c AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS k, country_code AS cc FROM company UNION ALL SELECT id + 1000000, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g'), 'PL' FROM company WHERE id % 5 = 0)
  SELECT q.req_id, CAST(coalesce((SELECT min(id) FROM c WHERE c.k = q.k AND c.cc = q.cc), (SELECT min(id) FROM c WHERE c.k = q.k)) AS VARCHAR) AS company_id FROM q""")
def _(spark, sf):
    co = B.companies(spark, sf).select("id", "name", "country_code")
    co = co.unionByName(co.where("id % 5 = 0").select((F.col("id") + 1_000_000).alias("id"), "name", F.lit("PL").alias("country_code")))
    req = B.requests(spark, sf).withColumn("name", F.upper(F.regexp_replace("name", "#", " - ")))
    return j.link_company(req, co, F.col("name"), F.col("country_code")).select("req_id", F.col("company_id").cast("string").alias("company_id"))


@query("audit_rows", "S19", "SELECT doc_id, 'compliance_check' AS action, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'bad' END AS outcome, sha256(text) AS original_data_hash FROM documents")
def _(spark, sf):
    d = B.table(spark, sf, "documents").selectExpr("cast(doc_id as string) as source_url", "text", "case when doc_id % 2 = 0 then 'ok' else 'bad' end as outcome")
    return g.audit_rows(d, "compliance_check", "outcome", "text").select(F.col("source_url").cast("bigint").alias("doc_id"), "action", "outcome", "original_data_hash")


@query("review_rows", "S20", "SELECT CAST(doc_id AS VARCHAR) AS source_url, 'pii_detected' AS reason, 'title,description' AS fields, 'pending' AS status FROM documents WHERE lang = 'de'")
def _(spark, sf):
    d = B.table(spark, sf, "documents").selectExpr("cast(doc_id as string) as source_url", "case when lang = 'de' then 'needs_review' else 'compliant' end as gdpr_status", "array('title', 'description') as gdpr_fields")
    return g.review_rows(d)


@query("insert_new", "S13", """WITH n AS (SELECT * FROM incident WHERE date_collected >= TIMESTAMP '2024-01-15'), o AS (SELECT * FROM incident WHERE date_collected < TIMESTAMP '2024-01-15' OR severity = 'low')
  SELECT id, source_url, title FROM n WHERE source_url IS NULL UNION ALL SELECT id, source_url, title FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY date_collected, id) AS rn FROM n WHERE source_url IS NOT NULL) WHERE rn = 1 AND source_url NOT IN (SELECT source_url FROM o WHERE source_url IS NOT NULL)""")
def _(spark, sf):
    i = B.incidents(spark, sf).withColumn("raw_text", F.col("description"))
    new = i.where("date_collected >= timestamp_ntz'2024-01-15'")
    old = i.where("date_collected < timestamp_ntz'2024-01-15' or severity = 'low'")
    return ir.insert_new(new, old, [F.asc("date_collected"), F.asc("id")]).select("id", "source_url", "title")


@query("upsert_sources", "S14", f"""WITH b AS (SELECT source_name AS name, count(*) AS n, min(source_type) AS st FROM incident GROUP BY 1) SELECT coalesce(s.name, b.name) AS name, coalesce(s.source_type, b.st) AS source_type, coalesce(s.id, 0) + coalesce(b.n, 0) AS total_events_collected,
  CASE WHEN b.n IS NOT NULL THEN '{B.AS_OF}.000000' END AS last_scraped FROM (SELECT * FROM source WHERE is_official) s FULL JOIN b ON s.name = b.name""")
def _(spark, sf):
    from cordon.session import as_ts

    dim = B.sources(spark, sf).where("is_official").withColumn("total_events_collected", F.col("id")).withColumn("last_scraped", F.lit(None).cast("timestamp_ntz"))
    return ir.upsert_sources(dim, B.incidents(spark, sf), as_ts(B.AS_OF)).select("name", "source_type", "total_events_collected", "last_scraped")


@query("upsert_status", "S15", f"""WITH r AS (SELECT country_code, source_type AS agent_type, max_by(severity, date_collected) AS st, max(date_collected) AS at, sum(id % 3)::BIGINT AS ev, sum(id % 2)::BIGINT AS er, max_by(title, date_collected) FILTER (id % 7 = 0) AS msg FROM incident GROUP BY 1, 2)
  SELECT coalesce(a.country_code, r.country_code) AS country_code, coalesce(a.agent_type, r.agent_type) AS agent_type, coalesce(r.st, a.status) AS status, {ts('coalesce(r.at, a.last_heartbeat)')} AS last_heartbeat,
  coalesce(a.events_collected_today, 0) + coalesce(r.ev, 0) AS events_collected_today, coalesce(a.errors_today, 0) + coalesce(r.er, 0) AS errors_today, coalesce(r.msg, a.last_error) AS last_error
  FROM (SELECT * FROM agent WHERE status <> 'stopped') a FULL JOIN r ON a.country_code = r.country_code AND a.agent_type = r.agent_type""")
def _(spark, sf):
    runs = B.incidents(spark, sf).selectExpr("country_code", "source_type as agent_type", "severity as status", "id % 3 as events", "id % 2 as errors", "case when id % 7 = 0 then title end as error_message", "date_collected as run_at")
    return ir.upsert_status(B.agent_status(spark, sf).where("status <> 'stopped'"), runs)


@query("road_alert_rows", "S16", """SELECT timestamp, country, type, location, description, 'unknown' AS source_channel FROM road_alert""")
def _(spark, sf):
    d = B.road_alerts(spark, sf).withColumn("source_channel", F.lit(None).cast("string")).withColumn("language", F.lit("en")).withColumn("raw_text", F.col("description"))
    return ra.alert_rows(d).select("timestamp", "country", "type", "location", "description", "source_channel")


@query("recent_road_alerts", "S17", """SELECT id, timestamp, country FROM road_alert WHERE CAST(timestamp AS TIMESTAMP) >= TIMESTAMP '2024-01-29 00:00:00' AND country = 'PL' AND type = 'accident' ORDER BY timestamp DESC, location, description LIMIT 100""")
def _(spark, sf):
    return ra.recent(B.road_alerts(spark, sf), B.AS_OF, 48, "pl", "accident").select("id", "timestamp", "country")


@query("feed_items", "S4", """SELECT 'http://x.example.org/' || CAST(doc_id - doc_id % 2 AS VARCHAR) AS source_url, 'Note & ' || source AS title, '2024-01-10 08:00:00.000000' AS date, any_value(x) AS n FROM (SELECT *, 'b ' || lang AS x FROM documents) WHERE doc_id % 2 = 0 GROUP BY ALL""".replace("any_value(x) AS n", "'b ' || lang AS description").replace(" GROUP BY ALL", "").replace("(SELECT *, 'b ' || lang AS x FROM documents)", "documents"))
def _(spark, sf):
    d = B.table(spark, sf, "documents")
    xml = """concat('<rss><channel><title>t</title><item><title>&lt;b&gt;Note &amp;amp; ', source, '&lt;/b&gt;</title><link>http://x.example.org/', cast(doc_id - doc_id % 2 as string), '</link><description>&lt;i&gt;b&lt;/i&gt; ', lang, '</description><pubDate>Wed, 10 Jan 2024 08:00:00 +0000</pubDate></item></channel></rss>')"""
    return feeds.feed_items(d.selectExpr("doc_id as feed_id", f"{xml} as xml")).select("source_url", "title", "date", "description")


@query("article_text", "S7")
def _(spark, sf):
    return pages.article_text(B.table(spark, sf, "pages")).select("page_id", F.length("article").alias("n"), F.md5("article").alias("digest"))


@query("page_items", "S5")
def _(spark, sf):
    return pages.page_items(B.table(spark, sf, "pages"), {"selectors": ["nav li"], "domain": "https://example.org"}).select("page_id", "pos", F.md5("title").alias("title"), F.length("description").alias("n"), "date")


@query("forum_items", "S6")
def _(spark, sf):
    p = B.table(spark, sf, "pages").withColumn(
        "html", F.expr("replace(html, '<nav>', concat('<div class=\"topic\"><a href=\"/t/', cast(page_id as string), '\">Thread about page ', cast(page_id as string), '</a></div><nav>'))"))
    return pages.forum_items(p).select("page_id", "pos", "engine", "source_url")


@query("notice_items", "S11")
def _(spark, sf):
    return pages.notice_items(B.table(spark, sf, "pages")).select("page_id", "pos", "proceeding", "court", "decision")


@query("debt_items", "S12")
def _(spark, sf):
    return pages.debt_items(B.table(spark, sf, "pages")).select("page_id", "pos", "debt_type", "event_type", "amount_eur")


@query("registry_insolvencies", "S9", """SELECT CAST(c_custkey AS VARCHAR) AS company_number, c_name || ' — ' || CASE c_custkey % 3 WHEN 0 THEN 'liquidation' ELSE 'receivership' END AS title,
  'Company ' || CAST(c_custkey AS VARCHAR) || ' (' || c_name || ') — status: ' || CASE c_custkey % 3 WHEN 0 THEN 'liquidation' ELSE 'receivership' END || '. Address: 1 Road, ' || c_mktsegment || '.' || CASE WHEN c_custkey % 2 = 0 THEN ' Cessation date: 2024-01-02.' ELSE '' END AS description, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02' ELSE '2001-05-05' END AS date FROM customer WHERE c_custkey % 3 < 2 AND c_custkey % 4 > 0""")
def _(spark, sf):
    item = """named_struct('company_name', c_name, 'company_number', cast(c_custkey as string), 'company_status', case c_custkey % 3 when 0 then 'liquidation' when 1 then 'receivership' else 'active' end,
      'sic_codes', array(case when c_custkey % 4 > 0 then '4941' else '6201' end), 'date_of_cessation', case when c_custkey % 2 = 0 then '2024-01-02' end, 'date_of_creation', '2001-05-05',
      'registered_office_address', named_struct('address_line_1', '1 Road', 'locality', c_mktsegment))"""
    d = B.table(spark, sf, "customer").selectExpr("c_custkey as snapshot_id", f"to_json(named_struct('items', array({item}, {item}))) as json")
    return registries.registry_insolvencies(d).select("company_number", "title", "description", "date")


@query("register_inactive", "S10", """SELECT '[DEBT] ' || c_name || ' Freight — ' || k AS title, k AS debt_type, 'bankruptcy' AS event_type, CASE WHEN c_custkey % 2 = 0 THEN 'GB' ELSE 'EU' END AS country_code, 'debt_registry,' || k || ',OpenCorporates' AS tags FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'liquidation' ELSE 'insolvency' END AS k FROM customer WHERE c_custkey % 3 < 2)""")
def _(spark, sf):
    co = "named_struct('company', named_struct('name', concat(c_name, ' Freight'), 'current_status', case c_custkey % 3 when 0 then 'In Liquidation' when 1 then 'Dissolved' else 'Active' end, 'jurisdiction_code', case when c_custkey % 2 = 0 then 'gb' else '' end, 'updated_at', '2024-01-01'))"
    d = B.table(spark, sf, "customer").selectExpr("c_custkey as payload_id", f"to_json(named_struct('results', named_struct('companies', array({co})))) as json")
    return registries.register_inactive(d).select("title", "debt_type", "event_type", "country_code", "tags")



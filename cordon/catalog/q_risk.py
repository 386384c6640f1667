"""Risk scores, company checks and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import WEIGHT, case, decay, half
from cordon.catalog.registry import query
from cordon.functions import score as sc
from cordon.operators import company as c
from cordon.operators import joins as j
from cordon.operators import risk as r
from cordon.refdata import fixed as V

NOW = "2024-04-10 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"
DEC = decay("date_occurred", NOW_SQL)
FIN, OPS = str(V.FINANCIAL_TYPES)[1:-1], str(V.OPERATIONAL_TYPES)[1:-1]


def lvl(x):
    return f"CASE WHEN {x} >= 80 THEN 'CRITICAL' WHEN {x} >= 60 THEN 'HIGH' WHEN {x} >= 40 THEN 'MEDIUM' WHEN {x} >= 20 THEN 'LOW' ELSE 'MINIMAL' END"


def clvl(x):
    return f"CASE WHEN {x} >= 70 THEN 'critical' WHEN {x} >= 40 THEN 'high' WHEN {x} >= 20 THEN 'medium' ELSE 'low' END"


@query("time_decay", "K1", f"SELECT id, CAST({DEC} AS DOUBLE) AS decay FROM incident")
def _(spark, sf):
    return B.incidents(spark, sf).select("id", sc.decay("date_occurred", NOW).alias("decay"))


CR = f"""WITH e AS (SELECT company_id, event_type, {WEIGHT} * {DEC} AS w, {DEC} AS d FROM incident),
  g AS (SELECT company_id, count(*) AS n, sum(CASE WHEN event_type IN ({FIN}) THEN w ELSE 0 END) AS f, sum(CASE WHEN event_type IN ({OPS}) THEN w ELSE 0 END) AS o,
    count(*) FILTER (d = 1.0) AS recent, count(*) FILTER (d > 0.5 AND d < 1.0) AS older FROM e GROUP BY 1),
  l AS (SELECT company_id, count(*) AS delays FROM financial WHERE event_type = 'payment_delay' AND amount_eur > 400000 GROUP BY 1),
  m AS (SELECT g.*, coalesce(l.delays, 0) AS delays, CASE WHEN recent >= 5 THEN 2.0 WHEN recent >= 3 THEN 1.5 ELSE 1.0 END AS k FROM g LEFT JOIN l USING (company_id)),
  s AS (SELECT company_id, n AS event_count, least(100.0, least(100.0, {half('f * k', 1)}) + delays * 15)::DOUBLE AS financial_score, least(100.0, {half('o * k', 1)})::DOUBLE AS operational_score,
    least(100.0, least(100.0, {half('(f + o) * k', 1)}) + delays * 15)::DOUBLE AS overall_score, CASE WHEN recent > older * 1.5 THEN 'RISING' WHEN recent < older * 0.5 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM m)
  SELECT company_id, event_count, financial_score, operational_score, overall_score, {lvl('overall_score')} AS risk_level, trend FROM s"""


@query("company_risk", "K2", CR)
def _(spark, sf):
    fin = B.financials(spark, sf).selectExpr("company_id", "case when event_type = 'payment_delay' then 'payment_delays' else event_type end as metric", "case when amount_eur > 400000 then 61 else 10 end as value")
    return r.company_risk(B.incidents(spark, sf), fin, NOW).select("company_id", "event_count", "financial_score", "operational_score", "overall_score", "risk_level", "trend")


from cordon.catalog.q_geo import RT  # noqa: E402


@query("route_risk", "K3", f"""WITH p AS (SELECT r.route_id, i.* FROM incident i JOIN route r ON {RT} <= 80), h AS (SELECT r.route_id, count(*) AS h FROM hotspot i JOIN route r ON {RT} <= 80 GROUP BY 1),
  g AS (SELECT route_id, count(*) AS event_count, sum({WEIGHT} * {DEC}) AS w, count(*) FILTER (hour(date_occurred) >= 22 OR hour(date_occurred) < 5) AS night_events FROM p GROUP BY 1),
  a AS (SELECT route_id, string_agg(area, ',' ORDER BY area) AS high_risk_areas FROM (SELECT DISTINCT route_id, coalesce(city, region) || CASE WHEN road IS NOT NULL THEN ' (' || road || ')' ELSE '' END AS area FROM p WHERE coalesce(city, region) IS NOT NULL) GROUP BY 1)
  SELECT g.route_id, event_count, coalesce(h, 0) AS hotspots, night_events, least(100.0, {half('w + coalesce(h, 0) * 5 + night_events * 3', 1)})::DOUBLE AS overall_score, high_risk_areas FROM g LEFT JOIN h USING (route_id) LEFT JOIN a USING (route_id)""")
def _(spark, sf):
    routes = B.routes(spark, sf)
    on = j.course_join(B.incidents(spark, sf), routes, 80.0)
    hs = j.course_join(B.stored_hotspots(spark, sf), routes, 80.0).select("route_id")
    return j.of_shape(r.route_risk(on, hs, NOW), routes).select("route_id", "event_count", "hotspots", "night_events", "overall_score", "high_risk_areas")


@query("region_risk", "K4,W3", f"""WITH m AS (SELECT q.req_id, i.event_type, i.date_occurred FROM incident i JOIN region_request q ON i.country_code = q.country_code AND (i.region IS NULL OR contains(lower(i.region), lower(q.region)) OR contains(lower(q.region), lower(i.region)))),
  g AS (SELECT req_id, count(*) AS n, sum({WEIGHT} * {DEC}) AS w, count(*) FILTER ({DEC} >= 0.75) AS recent, count(*) FILTER ({DEC} < 0.75) AS older FROM m GROUP BY 1),
  t AS (SELECT req_id, event_type AS dominant_type FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY count(*) DESC, event_type) = 1)
  SELECT q.req_id, coalesce(n, 0) AS event_count, coalesce(least(100.0, {half('w', 1)}), 0)::DOUBLE AS overall_score, coalesce(dominant_type, 'other') AS dominant_type,
  CASE WHEN recent > older * 1.5 THEN 'RISING' WHEN recent < older * 0.5 AND older > 0 THEN 'DECLINING' ELSE 'STABLE' END AS trend FROM region_request q LEFT JOIN g USING (req_id) LEFT JOIN t USING (req_id)""")
def _(spark, sf):
    return r.region_risk(B.incidents(spark, sf), B.region_requests(spark, sf), NOW).select("req_id", "event_count", "overall_score", "dominant_type", "trend")


BASE = case("lower(cargo_type)", V.CARGO_BASE_RISK, "0.3")


@query("cargo_risk", "K5", f"""WITH c AS (SELECT id, coalesce(cargo_type, 'none') AS cargo_type, ((id % 50) * 2)::DOUBLE AS rs, id % 2 = 0 AS night FROM incident), b AS (SELECT *, CASE WHEN id % 5 = 0 THEN {BASE} ELSE least(1.0, {BASE} + rs / 200.0) END AS v FROM c)
  SELECT id, {half("CASE WHEN night AND id % 5 > 0 AND cargo_type IN ('electronics', 'pharmaceuticals') THEN least(1.0, v + 0.1) ELSE v END", 2)} AS cargo_risk FROM b""")
def _(spark, sf):
    d = B.incidents(spark, sf).selectExpr("id", "coalesce(cargo_type, 'none') as cargo_type", "case when id % 5 > 0 then cast((id % 50) * 2 as double) end as route_score", "id % 2 = 0 as night_risk")
    return r.cargo_risk(d).select("id", "cargo_risk")


@query("risk_report", "K6", f"""WITH c AS (SELECT company_id AS k, overall_score AS s FROM ({CR})), g AS (SELECT s_suppkey AS k, abs(s_acctbal) % 100 AS s FROM supplier),
  n AS (SELECT CAST(n_nationkey AS BIGINT) AS k, (n_nationkey * 4)::DOUBLE AS s FROM nation), a AS (SELECT k, max(s) AS s FROM (SELECT * FROM c UNION ALL SELECT * FROM g UNION ALL SELECT * FROM n) GROUP BY 1)
  SELECT k AS subject_id, round(s, 4) AS overall_score, {lvl('s')} AS overall_level FROM a""")
def _(spark, sf):
    fin = B.financials(spark, sf).selectExpr("company_id", "case when event_type = 'payment_delay' then 'payment_delays' else event_type end as metric", "case when amount_eur > 400000 then 61 else 10 end as value")
    co = r.company_risk(B.incidents(spark, sf), fin, NOW).withColumnRenamed("company_id", "subject_id")
    ro = B.table(spark, sf, "supplier").selectExpr("s_suppkey as subject_id", "abs(s_acctbal) % 100 as overall_score", "array('standard_precautions') as advice")
    re = B.table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as subject_id", "cast(n_nationkey * 4 as double) as overall_score")
    return r.risk_report(co, ro, re).select("subject_id", F.round("overall_score", 4).alias("overall_score"), "overall_level")


CHECK = f"""WITH m AS (SELECT q.req_id, c.id AS cid, c.name AS cname, c.country_code AS cc, c.financial_status AS fs, c.risk_score AS rs FROM request q JOIN company c ON contains(lower(c.name), lower(q.name))
    QUALIFY row_number() OVER (PARTITION BY q.req_id ORDER BY (c.country_code = q.country_code) DESC, length(c.name), c.id) = 1),
  p AS (SELECT req_id, id, max(named) AS named FROM (SELECT q.req_id, i.id, 1 AS named FROM request q JOIN incident i ON contains(lower(i.title), lower(q.name)) OR contains(lower(i.description), lower(q.name))
    UNION ALL SELECT m.req_id, i.id, 0 FROM m JOIN incident i ON i.company_id = m.cid) GROUP BY 1, 2),
  f AS (SELECT p.req_id, count(*) AS related, count(*) FILTER (i.date_occurred >= {NOW_SQL} - INTERVAL 90 DAY) AS recent, count(*) FILTER (named = 1 AND (i.intelligence_category = 'insolvency' OR i.event_type = 'bankruptcy')) AS ins,
    count(*) FILTER (named = 1 AND i.event_type = 'payment_issue') AS pay, count(*) FILTER (named = 1 AND list_contains(i.tags, 'debt_registry')) AS debt FROM p JOIN incident i ON i.id = p.id GROUP BY 1),
  fe AS (SELECT company_id, count(*) AS n FROM financial WHERE event_type IN ('bankruptcy_filing', 'license_revoked', 'license_suspended') GROUP BY 1),
  v AS (SELECT q.req_id, coalesce(bool_or(vat.valid), false) AS ok FROM request q LEFT JOIN vat ON vat.country_code = substr(q.vat_number, 1, 2) AND vat.vat_number = substr(q.vat_number, 3) WHERE length(q.vat_number) >= 4 GROUP BY 1),
  s AS (SELECT q.req_id, m.cid, m.rs, coalesce(related, 0) AS related, coalesce(recent, 0) AS recent,
    CASE WHEN fs IN ('bankrupt', 'critical') THEN 40 WHEN fs IN ('warning', 'restructuring') THEN 25 ELSE 0 END + CASE WHEN recent >= 5 THEN 25 WHEN recent >= 2 THEN 10 ELSE 0 END + coalesce(fe.n, 0) * 40 + CASE WHEN ins > 0 THEN 40 ELSE 0 END
    + CASE WHEN pay >= 3 THEN 25 WHEN pay > 0 THEN 10 ELSE 0 END + CASE WHEN debt >= 3 THEN 40 WHEN debt > 0 THEN 25 ELSE 0 END + CASE WHEN v.ok = false THEN 25 ELSE 0 END AS raw
    FROM request q LEFT JOIN m USING (req_id) LEFT JOIN f USING (req_id) LEFT JOIN fe ON fe.company_id = m.cid LEFT JOIN v USING (req_id))
  SELECT req_id, cid IS NOT NULL AS found_in_db, related AS related_events, recent AS recent_events, {half('greatest(least(100, raw), coalesce(rs, 0))', 1)} AS risk_score, {clvl('greatest(least(100, raw), coalesce(rs, 0))')} AS risk_level FROM s"""


@query("company_check", "K7,J2,J3,J12", CHECK)
def _(spark, sf):
    return c.company_check(B.requests(spark, sf), B.companies(spark, sf), B.incidents(spark, sf), B.financials(spark, sf), B.vat_table(spark, sf), NOW).select(
        "req_id", "found_in_db", "related_events", "recent_events", "risk_score", "risk_level")


def warn(name, base, step, cap, cond):
    return f"""SELECT company_id, '{name}' AS signal, least({cap}, round({base} + count(*) * {step}, 2))::DOUBLE AS confidence, count(*) AS event_count, min(strftime(date_occurred, '%Y-%m-%d')) AS first_seen FROM t WHERE {cond} GROUP BY 1"""


def words(ws):
    return "(" + " OR ".join(f"contains(x, '{w}')" for w in ws) + ")"


@query("early_warnings", "K8", "WITH t AS (SELECT *, lower(event_type || ' ' || title || ' ' || description) AS x FROM incident) " + " UNION ALL ".join(
    [warn(n, b, s, cap, words(ws)) for n, b, s, cap, ws in V.WARNING_TERMS] + [warn("cargo_issues", 0.2, 0.1, 0.8, "event_type IN ('theft_cargo', 'theft_fuel', 'theft_vehicle', 'damage')"), warn("activity_spike", 0.2, 0.05, 0.7, "true") + " HAVING count(*) >= 5"]))
def _(spark, sf):
    return c.early_warnings(B.incidents(spark, sf))


@query("hotspot_verdict", "K9", """WITH g AS (SELECT country_code, region, count(*) AS event_count, count(DISTINCT event_type) AS type_count, count(*) FILTER (severity = 'critical') AS cr, count(*) FILTER (severity IN ('critical', 'high')) AS se FROM incident WHERE region IS NOT NULL GROUP BY 1, 2),
  t AS (SELECT country_code, region, event_type, count(*) AS n FROM incident WHERE region IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY country_code, region ORDER BY count(*) DESC, event_type) = 1)
  SELECT g.country_code, g.region, event_count, type_count, t.event_type AS top_type, t.n AS top_type_count, CASE WHEN se >= 3 OR cr >= 1 THEN 'CRITICAL' WHEN se >= 1 OR event_count >= 5 THEN 'HIGH' WHEN event_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
  FROM g JOIN t ON g.country_code = t.country_code AND g.region = t.region""")
def _(spark, sf):
    return c.hotspot_verdict(B.incidents(spark, sf))


@query("corridor_verdict", "K10", """WITH e AS (SELECT s.corridor, i.country_code, i.country_code || '/' || coalesce(i.region, '') AS place FROM incident i JOIN corridor_segment s ON i.country_code = s.cc AND i.road = s.road)
  SELECT e.corridor, count(*) AS total_events, string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS countries, any_value(h.l) AS hotspots FROM e JOIN (SELECT corridor, string_agg(place, ',' ORDER BY rn) AS l FROM
  (SELECT corridor, place, row_number() OVER (PARTITION BY corridor ORDER BY count(*) DESC, place) AS rn FROM e GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1) h ON h.corridor = e.corridor GROUP BY 1""")
def _(spark, sf):
    return c.corridor_verdict(j.corridor_events(B.incidents(spark, sf), j.segments(spark)))


SP = case("financial_status", V.STATUS_POINTS, "10")


@query("company_verdict", "K11", f"""WITH n AS (SELECT company_id, count(*) AS n FROM incident GROUP BY 1), s AS (SELECT c.id, least(50, coalesce(n.n, 0) * 10) + {SP} AS sc, n.n, financial_status FROM company c LEFT JOIN n ON n.company_id = c.id)
  SELECT id AS company_id, CAST(least(100, sc) AS BIGINT) AS risk_score, CASE WHEN sc >= 50 THEN 'verify' ELSE 'monitor' END AS recommendation FROM s""")
def _(spark, sf):
    return c.company_verdict(B.companies(spark, sf), B.incidents(spark, sf)).select("company_id", "risk_score", "recommendation")


@query("diligence", "K13", f"""WITH g AS (SELECT o_custkey AS company_id, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderkey % 9 = 0) AS a, count(*) FILTER (o_orderkey % 7 = 0) AS b, count(*) FILTER (o_orderkey % 11 = 0) AS l, count(*) FILTER (o_orderkey % 13 = 0) AS w FROM orders GROUP BY 1)
  SELECT company_id, a + b + l + w AS risk_signals, CAST(least(100, a * 30 + b * 20 + l * 20 + w * 30) AS BIGINT) AS risk_score, upper({clvl('least(100, a * 30 + b * 20 + l * 20 + w * 30)')}) AS risk_level, round(least(0.8, ok / n::DOUBLE), 6)::DOUBLE AS confidence, CASE WHEN a + b + l + w > 0 THEN 'CAUTION' ELSE 'YES_WITH_CONDITIONS' END AS do_business FROM g""")
def _(spark, sf):
    rows = B.table(spark, sf, "orders").selectExpr(
        "o_custkey as company_id", "o_orderpriority as source", "case when o_orderstatus = 'P' then 'error' else 'ok' end as status", "o_orderkey % 9 = 0 as insolvency_found",
        "o_orderkey % 7 = 0 as debt_found", "o_orderkey % 11 = 0 as license_issues_found", "o_orderkey % 13 = 0 as winding_up_found")
    return c.diligence(rows).withColumn("confidence", F.round("confidence", 6))


@query("related_companies", "K14", f"""WITH m AS (SELECT q.req_id, c.id AS cid, c.financial_status FROM request q JOIN company c ON contains(lower(c.name), lower(q.name)) QUALIFY row_number() OVER (PARTITION BY q.req_id ORDER BY (c.country_code = q.country_code) DESC, length(c.name), c.id) = 1),
  n AS (SELECT company_id, count(*) AS n FROM incident WHERE date_collected >= {NOW_SQL} - INTERVAL 90 DAY GROUP BY 1)
  SELECT q.req_id, q.name, m.cid IS NOT NULL AS in_store, m.financial_status, CAST(CASE WHEN m.cid IS NOT NULL THEN coalesce(n.n, 0) END AS VARCHAR) AS recent_events FROM request q LEFT JOIN m USING (req_id) LEFT JOIN n ON n.company_id = m.cid""")
def _(spark, sf):
    return c.related_enrich(B.requests(spark, sf), B.companies(spark, sf), B.incidents(spark, sf), NOW).select("req_id", "name", "in_store", "financial_status", F.col("recent_events").cast("string").alias("recent_events"))


@query("dossier", "K15,J3", f"""WITH m AS (SELECT q.req_id, c.id AS cid FROM request q JOIN company c ON contains(lower(c.name), lower(q.name)) QUALIFY row_number() OVER (PARTITION BY q.req_id ORDER BY (c.country_code = q.country_code) DESC, length(c.name), c.id) = 1),
  e AS (SELECT company_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS l FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY date_occurred DESC, id DESC) AS rn FROM incident) WHERE rn <= 30 GROUP BY 1),
  f AS (SELECT company_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS l FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY date_occurred DESC, id DESC) AS rn FROM financial) WHERE rn <= 20 GROUP BY 1)
  SELECT q.req_id, e.l AS events, f.l AS financials FROM request q LEFT JOIN m USING (req_id) LEFT JOIN e ON e.company_id = m.cid LEFT JOIN f ON f.company_id = m.cid""")
def _(spark, sf):
    d = c.dossier(B.requests(spark, sf), B.companies(spark, sf), B.incidents(spark, sf), B.financials(spark, sf))
    return d.select("req_id", F.transform("events", lambda x: x["id"]).alias("events"), F.transform("financials", lambda x: x["id"]).alias("financials"))


@query("company_detail", "K16", f"""SELECT c.id AS company_id, name, coalesce(e.n, 0) AS events, coalesce(f.n, 0) AS financials, coalesce(f.t, 0) AS financial_total, round(least(40.0, risk_score * 0.4), 4)::DOUBLE AS financial_events_part, round(least(30.0, risk_score * 0.3), 4)::DOUBLE AS operational_events_part,
  CASE WHEN risk_score > 60 THEN 20.0 ELSE 0.0 END::DOUBLE AS combined_bonus, risk_score AS total FROM company c LEFT JOIN (SELECT company_id, count(*) AS n FROM incident GROUP BY 1) e ON e.company_id = c.id LEFT JOIN (SELECT company_id, count(*) AS n, {half('sum(amount_eur)', 2)} AS t FROM financial GROUP BY 1) f ON f.company_id = c.id""")
def _(spark, sf):
    return c.company_detail(B.companies(spark, sf), B.incidents(spark, sf), B.financials(spark, sf))



"""Counts, series, overviews, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import AS_OF, case, half, sev, ts
from cordon.catalog.registry import query
from cordon.operators import joins as j
from cordon.operators import stats as s
from cordon.operators import windows as w
from cordon.refdata import fixed as V

ACTION = "(intelligence_tier <= 2 OR intelligence_tier IS NULL)"
THEFT = str(V.THEFT_TYPES)[1:-1]
FIN = str(V.FINANCIAL_TYPES)[1:-1]


def dim(name: str, key: str, src: str = "incident", where: str = "") -> str:
    return f"SELECT '{name}' AS dim, CAST({key} AS VARCHAR) AS key, count(*) AS n FROM {src} {where} GROUP BY 2"


def stacked(tables: dict[str, DataFrame], rows: dict[str, tuple[str, str]]) -> DataFrame:
    """Several small tables as one (part, key, value) table for checking."""
    parts = [tables[t].select(F.lit(t).alias("part"), F.expr(k).cast("string").alias("key"), F.expr(v).cast("double").alias("value")) for t, (k, v) in rows.items()]
    return reduce(DataFrame.unionByName, parts)


@query("event_stats", "A1", f"{dim('country', 'country_code')} UNION ALL {dim('event_type', 'event_type')} UNION ALL {dim('severity', 'upper(severity)')} UNION ALL SELECT 'total', NULL, count(*) FROM incident")
def _(spark, sf):
    return s.event_stats(B.incidents(spark, sf))


@query("daily_counts", "A2", f"""SELECT strftime(d.day, '%Y-%m-%d') AS day, count(i.id) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN (SELECT * FROM incident WHERE date_occurred >= {AS_OF} - INTERVAL 30 DAY) i ON CAST(i.date_occurred AS DATE) = d.day GROUP BY 1""")
def _(spark, sf):
    return s.daily_counts(B.incidents(spark, sf), B.AS_OF)


@query("timeline_day", "A3", "SELECT strftime(date_occurred, '%Y-%m-%d') AS period, count(*) AS n FROM incident GROUP BY 1")
def _(spark, sf):
    return s.timeline(B.incidents(spark, sf))


@query("timeline_week", "A3", "SELECT strftime(o_orderdate, '%Y-W%W') AS period, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return s.timeline(B.table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_orderdate as date_occurred"), "week")


OV = "2024-01-24 15:00:00"


@query("overview_counts", "A4", f"""SELECT count(*) FILTER (date_occurred >= TIMESTAMP '2024-01-24') AS events_today, count(*) FILTER (date_occurred >= TIMESTAMP '2024-01-22') AS events_this_week,
  count(*) FILTER (date_occurred >= TIMESTAMP '2024-01-01') AS events_this_month FROM incident WHERE {ACTION}""")
def _(spark, sf):
    return s.overview_counts(B.incidents(spark, sf), OV)


@query("overview", "A4", """SELECT 'by_severity' AS part, upper(severity) AS key, count(*)::DOUBLE AS value FROM incident GROUP BY 2
  UNION ALL SELECT 'active_alerts', 'n', count(*)::DOUBLE FROM alert WHERE is_active
  UNION ALL SELECT 'agents', status, count(*)::DOUBLE FROM agent GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'top_countries', country_code, count(*)::DOUBLE AS n FROM incident GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'latest', CAST(id AS VARCHAR), trust_score FROM incident ORDER BY date_occurred DESC, id DESC LIMIT 10)""")
def _(spark, sf):
    t = s.overview(B.incidents(spark, sf), B.alerts(spark, sf), B.agent_status(spark, sf), OV)
    return stacked(t, {"by_severity": ("severity", "n"), "active_alerts": ("'n'", "n"), "agents": ("status", "n"), "top_countries": ("country_code", "n"), "latest": ("id", "trust_score")})


@query("map_payload", "A5", """SELECT 'hotspots' AS part, region AS key, event_count::DOUBLE AS value FROM hotspot UNION ALL SELECT 'density', country_code, count(*)::DOUBLE FROM incident GROUP BY 2
  UNION ALL SELECT * FROM (SELECT 'alerts', upper(severity) || coalesce(country_codes[1], ''), id::DOUBLE FROM alert WHERE is_active ORDER BY triggered_at DESC, id LIMIT 10)""")
def _(spark, sf):
    t = s.map_payload(B.stored_hotspots(spark, sf), B.alerts(spark, sf), B.incidents(spark, sf))
    return stacked(t, {"hotspots": ("label", "event_count"), "density": ("country_code", "n"), "alerts": ("concat(severity, coalesce(country_code, ''))", "id")})


CAL90 = "SELECT CAST(unnest(generate_series(DATE '2023-11-03', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day"


@query("trend_series", "A6", f"""WITH i AS (SELECT *, CAST(date_occurred AS DATE) AS day FROM incident WHERE date_occurred >= {AS_OF} - INTERVAL 90 DAY),
  k AS (SELECT 'all' AS series, 'all' AS key UNION ALL SELECT DISTINCT 'event_type', event_type FROM i UNION ALL
    SELECT 'country', country_code FROM (SELECT country_code, count(*) AS n FROM incident GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5)),
  x AS (SELECT day, unnest([{{'series': 'all', 'key': 'all'}}, {{'series': 'event_type', 'key': event_type}}, {{'series': 'country', 'key': country_code}}]) AS s FROM i),
  n AS (SELECT s.series AS series, s.key AS key, day, count(*) AS n FROM x GROUP BY ALL)
  SELECT k.series, k.key, strftime(c.day, '%Y-%m-%d') AS day, coalesce(n.n, 0) AS n FROM k CROSS JOIN ({CAL90}) c LEFT JOIN n ON n.series = k.series AND n.key = k.key AND n.day = c.day""")
def _(spark, sf):
    return s.trend_series(B.incidents(spark, sf), B.AS_OF)


@query("week_over_week", "A6", f"""WITH b AS (SELECT (date_diff('day', CAST(date_occurred AS DATE), DATE '2024-01-31') - 1) // 7 AS w FROM incident WHERE date_diff('day', CAST(date_occurred AS DATE), DATE '2024-01-31') BETWEEN 1 AND 91),
  f AS (SELECT g.w, count(b.w) AS n FROM (SELECT unnest(range(13)) AS w) g LEFT JOIN b ON b.w = g.w GROUP BY 1)
  SELECT 'W' || CAST(12 - a.w AS VARCHAR) AS week, a.n, p.n AS prev_n, {half('(a.n - p.n) / greatest(p.n, 1)::DOUBLE * 100', 1)} AS change_pct FROM f a JOIN f p ON p.w = a.w + 1 WHERE a.w < 12""")
def _(spark, sf):
    return s.week_over_week(B.incidents(spark, sf), B.AS_OF)


@query("running_week", "A6,W3", f"""WITH c AS ({CAL90}), d AS (SELECT c.day, count(i.id) AS n FROM c LEFT JOIN (SELECT * FROM incident WHERE date_occurred >= {AS_OF} - INTERVAL 90 DAY) i ON CAST(i.date_occurred AS DATE) = c.day GROUP BY 1)
  SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week_sum FROM d""")
def _(spark, sf):
    return s.running_week(B.incidents(spark, sf), B.AS_OF)


@query("financial_overview", "A7", f"""SELECT id, name, country_code, upper(financial_status) AS financial_status, risk_score, financial_status = 'bankrupt' AS recent_bankruptcy, financial_status = 'critical' AS recent_revocation
  FROM company WHERE financial_status IN ({str(V.AT_RISK_STATUSES)[1:-1]})""".replace("financial_status = 'bankrupt'", "company.financial_status = 'bankrupt'").replace("financial_status = 'critical'", "company.financial_status = 'critical'").replace("WHERE financial_status", "WHERE company.financial_status"))
def _(spark, sf):
    return s.financial_overview(B.companies(spark, sf))


@query("payment_trend", "A7", "SELECT strftime(date_occurred, '%Y-%m') AS month, count(*) AS n FROM incident WHERE event_type = 'payment_issue' GROUP BY 1")
def _(spark, sf):
    return s.payment_trend(B.incidents(spark, sf))


@query("alert_stats", "A8", f"""SELECT 'active_severity' AS dim, upper(severity) AS key, count(*)::DOUBLE AS value FROM alert WHERE is_active GROUP BY 2
  UNION ALL SELECT 'country', country_codes[1], count(*)::DOUBLE FROM alert WHERE len(country_codes) > 0 GROUP BY 2
  UNION ALL SELECT 'total', 'total_active', count(*)::DOUBLE FROM alert WHERE is_active UNION ALL SELECT 'total', 'total_resolved', count(*)::DOUBLE FROM alert WHERE NOT is_active
  UNION ALL SELECT 'total', 'mean_hours', {half('avg((epoch_us(resolved_at) - epoch_us(triggered_at)) / 3.6e9)', 1)} FROM alert WHERE NOT is_active""")
def _(spark, sf):
    return s.alert_stats(B.alerts(spark, sf))


NAMES = case("country_code", V.COUNTRY_NAMES)


@query("agent_summary", "A9", f"""SELECT country_code, {NAMES} AS country_name, CASE WHEN count(*) FILTER (status IN ('error', 'running')) > 0 THEN 'running' ELSE 'stopped' END AS supervisor_status, count(*) AS agents,
  count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'stopped') AS stopped, count(*) FILTER (status = 'error') AS errors, sum(events_collected_today)::BIGINT AS events_today
  FROM agent GROUP BY GROUPING SETS ((country_code), ())""")
def _(spark, sf):
    return s.agent_summary(B.agent_status(spark, sf))


@query("agent_health", "A10", f"""WITH a AS (SELECT *, (epoch_us({AS_OF}) - epoch_us(last_heartbeat)) / 1e6 AS age FROM agent),
  f AS (SELECT *, age > 300 AS stale, errors_today > 5 AS noisy FROM a)
  SELECT country_code, agent_type, issue, CASE WHEN stale THEN {half('age / 60', 1)} END AS minutes_ago, errors_today FROM
  (SELECT *, unnest([x FOR x IN [CASE WHEN stale THEN 'heartbeat_stale' END, CASE WHEN noisy THEN 'high_error_rate' END, CASE WHEN stale OR noisy OR status = 'error' THEN 'unhealthy' ELSE 'healthy' END] IF x IS NOT NULL]) AS issue FROM f)""")
def _(spark, sf):
    return s.agent_health(B.agent_status(spark, sf), B.AS_OF)


NOW = "2024-01-20 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


@query("freshness", "A11", f"""SELECT last_30m, last_60m, last_24h, CASE WHEN last_30m > 0 THEN 'ok' WHEN last_60m > 0 THEN 'warning' ELSE 'critical' END AS status FROM (
  SELECT count(*) FILTER (date_collected >= {NOW_SQL} - INTERVAL 30 MINUTE) AS last_30m, count(*) FILTER (date_collected >= {NOW_SQL} - INTERVAL 60 MINUTE) AS last_60m,
  count(*) FILTER (date_collected >= {NOW_SQL} - INTERVAL 24 HOUR) AS last_24h FROM incident WHERE date_collected <= {NOW_SQL})""")
def _(spark, sf):
    return s.freshness(B.incidents(spark, sf), NOW)


DAY = f"date_collected >= {NOW_SQL} - INTERVAL 24 HOUR AND date_collected <= {NOW_SQL}"


@query("daily_digest", "A12", f"""SELECT 'totals' AS part, CAST(count(*) FILTER (severity = 'critical') AS VARCHAR) AS key, count(*)::DOUBLE AS value FROM incident WHERE {DAY}
  UNION ALL SELECT 'alerts', 'n', count(*)::DOUBLE FROM alert WHERE triggered_at >= {NOW_SQL} - INTERVAL 24 HOUR AND triggered_at <= {NOW_SQL}
  UNION ALL SELECT * FROM (SELECT 'top_events', severity || country_code, id::DOUBLE FROM incident WHERE {DAY} ORDER BY {sev()} DESC, date_collected, id LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'hotspots', region, event_count::DOUBLE FROM hotspot WHERE last_calculated >= {NOW_SQL} - INTERVAL 24 HOUR ORDER BY event_count DESC, country_code, region LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'companies', name, risk_score FROM company WHERE risk_score >= 70 ORDER BY risk_score DESC, id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'per_country', country_code, count(*)::DOUBLE FROM incident WHERE {DAY} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(spark, sf):
    t = s.daily_digest(B.incidents(spark, sf), B.alerts(spark, sf), B.stored_hotspots(spark, sf), B.companies(spark, sf), NOW)
    return stacked(t, {
        "totals": ("critical_count", "total_events"), "alerts": ("'n'", "alerts_count"), "top_events": ("concat(severity, country_code)", "id"),
        "hotspots": ("region", "event_count"), "companies": ("name", "risk_score"), "per_country": ("country_code", "n")})


@query("summary_24h", "A13", f"""{dim('event_type', 'event_type', 'incident', 'WHERE ' + DAY)} UNION ALL {dim('tier', 'intelligence_tier', 'incident', 'WHERE intelligence_tier IS NOT NULL AND ' + DAY)}
  UNION ALL SELECT 'total', NULL, count(*) FROM incident WHERE {DAY} UNION ALL SELECT 'thefts', NULL, count(*) FROM incident WHERE event_type IN ({THEFT}) AND {DAY}
  UNION ALL SELECT * FROM ({dim('country', 'country_code', 'incident', 'WHERE ' + DAY)} ORDER BY n DESC, key LIMIT 5)""")
def _(spark, sf):
    return s.summary_24h(B.incidents(spark, sf), NOW)


PLACE = "CASE WHEN region IS NOT NULL THEN country_code || '/' || region ELSE country_code END"


@query("exec_summary", "A14", f"""{dim('event_type', 'event_type')} UNION ALL {dim('country', 'country_code')} UNION ALL {dim('severity', 'upper(severity)')} UNION ALL SELECT 'total', NULL, count(*) FROM incident
  UNION ALL SELECT * FROM ({dim('place', PLACE)} ORDER BY n DESC, key LIMIT 3)
  UNION ALL SELECT * FROM ({dim('company', 'company_name', 'incident', f'WHERE is_official AND event_type IN ({FIN})')} ORDER BY n DESC, key LIMIT 3)""")
def _(spark, sf):
    return s.exec_summary(B.incidents(spark, sf))


@query("statistics", "A15", f"""SELECT dim, key, n::DOUBLE AS value FROM ({dim('event_type', 'event_type')} UNION ALL {dim('country', 'country_code')} UNION ALL {dim('severity', 'upper(severity)')} UNION ALL SELECT 'total', NULL, count(*) FROM incident
  UNION ALL SELECT * FROM ({dim('source', 'source_name')} ORDER BY n DESC, key LIMIT 10)) UNION ALL SELECT 'mean_trust', NULL, {half('avg(trust_score)', 2)} FROM incident""")
def _(spark, sf):
    return s.statistics(B.incidents(spark, sf))


@query("country_blocks", "A16", f"""WITH t AS (SELECT country_code, count(*) AS event_count FROM incident GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5),
  sv AS (SELECT country_code, string_agg(s || '=' || CAST(n AS VARCHAR), ',' ORDER BY s) AS severity_mix FROM (SELECT country_code, upper(severity) AS s, count(*) AS n FROM incident GROUP BY 1, 2) GROUP BY 1),
  rg AS (SELECT country_code, string_agg(region, ',' ORDER BY rn) AS top_regions FROM (SELECT country_code, region, row_number() OVER (PARTITION BY country_code ORDER BY count(*) DESC, region) AS rn FROM incident WHERE region IS NOT NULL GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1)
  SELECT t.country_code, t.event_count, sv.severity_mix, rg.top_regions FROM t JOIN sv USING (country_code) JOIN rg USING (country_code)""")
def _(spark, sf):
    return s.country_blocks(B.incidents(spark, sf))


def mode_sql(keys: str, col: str, src: str = "incident") -> str:
    return f"SELECT {keys}, {col} AS v, n FROM (SELECT {keys}, {col}, count(*) AS n, row_number() OVER (PARTITION BY {keys} ORDER BY count(*) DESC, {col}) AS rn FROM {src} GROUP BY {keys}, {col}) WHERE rn = 1"


@query("country_summary", "A21", f"""SELECT country_code, count(*) AS event_count, any_value(m.v) AS top_type, least(100.0, {half(f'sum({sev()}) * 2.5', 1)})::DOUBLE AS risk_score, {NAMES} AS country_name
  FROM incident JOIN ({mode_sql('country_code', 'event_type')}) m USING (country_code) GROUP BY country_code""")
def _(spark, sf):
    return s.country_summary(B.incidents(spark, sf)).drop("hotspot_count")


@query("corridor_risk", "A22,J8", f"""WITH e AS (SELECT i.*, m.corridor, {sev('i.severity')} AS sv FROM incident i JOIN corridor_member m ON i.country_code = m.cc AND (i.road IS NULL OR list_contains(m.roads, i.road))),
  m AS ({mode_sql('corridor', 'event_type', 'e')}), t AS (SELECT corridor, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS top_incidents FROM (SELECT corridor, id, row_number() OVER (PARTITION BY corridor ORDER BY sv DESC, id) AS rn FROM e) WHERE rn <= 3 GROUP BY 1)
  SELECT e.corridor, count(*) AS event_count, least(100.0, {half('sum(sv) * 3.0', 1)})::DOUBLE AS risk_score, any_value(m.v) AS dominant_type, any_value(t.top_incidents) AS top_incidents FROM e JOIN m ON m.corridor = e.corridor JOIN t ON t.corridor = e.corridor GROUP BY 1""")
def _(spark, sf):
    return s.corridor_risk(B.incidents(spark, sf), j.corridor_members(spark))


@query("tier_counts", "A23", "SELECT count(intelligence_tier) AS processed, " + ", ".join(f"count(*) FILTER (intelligence_tier = {t}) AS tier_{t}" for t in (1, 2, 3, 4)) + " FROM incident")
def _(spark, sf):
    return s.tier_counts(B.incidents(spark, sf))


@query("country_pairs", "A24", "WITH c AS (SELECT country_code, count(*) AS n FROM incident GROUP BY 1) SELECT a.country_code AS country_a, b.country_code AS country_b, a.n + b.n AS event_count FROM c a JOIN c b ON a.country_code < b.country_code WHERE a.n + b.n >= 3")
def _(spark, sf):
    return s.country_pairs(B.incidents(spark, sf))


CELL = "round(floor({c} / 0.5::DOUBLE) * 0.5::DOUBLE + 0.25::DOUBLE, 2)"


@query("heat_grid", "G11", f"""WITH c AS (SELECT {CELL.replace('{c}', 'latitude')} AS lat, {CELL.replace('{c}', 'longitude')} AS lon, count(*) AS event_count FROM incident GROUP BY 1, 2)
  SELECT lat, lon, event_count, {half('event_count / (max(event_count) OVER ())::DOUBLE', 3)} AS intensity FROM c""")
def _(spark, sf):
    return s.heat_grid(B.incidents(spark, sf))


PT = """SELECT coalesce(c.dim, p.dim) AS dim, coalesce(c.key, p.key) AS key, coalesce(c.n, 0) AS current, coalesce(p.n, 0) AS previous FROM (C) c FULL JOIN (P) p ON c.dim = p.dim AND c.key = p.key"""
CUR, PRV = "WHERE date_occurred >= TIMESTAMP '2024-01-16'", "WHERE date_occurred < TIMESTAMP '2024-01-16' AND event_type <> 'strike'"
_pt = PT.replace("(C)", f"({dim('country', 'country_code', 'incident', CUR)} UNION ALL {dim('event_type', 'event_type', 'incident', CUR)})").replace(
    "(P)", f"({dim('country', 'country_code', 'incident', PRV)} UNION ALL {dim('event_type', 'event_type', 'incident', PRV)})")


@query("period_trends", "W5,W7", f"""SELECT *, CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 100.0 ELSE 0.0 END ELSE {half('(current - previous) / nullif(previous, 0)::DOUBLE * 100', 1)} END AS change_pct,
  CASE WHEN previous = 0 THEN CASE WHEN current > 0 THEN 'new' ELSE 'stable' END WHEN (current - previous) / previous::DOUBLE * 100 > 15 THEN 'rising' WHEN (current - previous) / previous::DOUBLE * 100 < -15 THEN 'declining' ELSE 'stable' END AS trend,
  CASE WHEN dim <> 'country' THEN NULL WHEN current >= 3 AND previous < 3 THEN 'new' WHEN current < 3 AND previous >= 3 THEN 'fading' END AS hotspot_change FROM ({_pt})""")
def _(spark, sf):
    i = B.incidents(spark, sf)
    return s.period_trends(i.where("date_occurred >= timestamp_ntz'2024-01-16'"), i.where("date_occurred < timestamp_ntz'2024-01-16' and event_type <> 'strike'"))


@query("period_facts", "K12", f"""SELECT (SELECT count(*) FROM incident) AS total_events, (SELECT count(DISTINCT country_code) FROM incident) AS countries,
  (SELECT count(*) FROM incident WHERE severity IN ('critical', 'high')) AS serious_events, t.event_type AS top_type, t.n AS top_type_count, c.country_code AS top_country, c.n AS top_country_count
  FROM (SELECT event_type, count(*) AS n FROM incident GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) t, (SELECT country_code, count(*) AS n FROM incident GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) c""")
def _(spark, sf):
    return s.period_facts(B.incidents(spark, sf))


@query("country_facts", "K12", f"""WITH r AS (SELECT * FROM incident WHERE region IS NOT NULL) SELECT a.country_code, a.n AS event_count, t.v AS top_type, t.n AS top_type_count, g.v AS top_region, g.n AS top_region_count
  FROM (SELECT country_code, count(*) AS n FROM incident GROUP BY 1) a JOIN ({mode_sql('country_code', 'event_type')}) t USING (country_code) LEFT JOIN ({mode_sql('country_code', 'region', 'r')}) g USING (country_code)""")
def _(spark, sf):
    return s.country_facts(B.incidents(spark, sf))


# --- windows -----------------------------------------------------------------

BURST = f"""WITH e AS (SELECT company_id, id, epoch_us(date_occurred) AS us, country_code FROM incident WHERE event_type IN ({THEFT})),
  h AS (SELECT *, lead(us, 3) OVER (PARTITION BY company_id ORDER BY us, id) - us AS gap FROM e),
  f AS (SELECT company_id, min((us, id)) AS k FROM h WHERE gap < 7 * 86400000000 GROUP BY 1),
  c AS (SELECT e.company_id, f.k[2] AS first_id, f.k[1] AS us, count(*) AS event_count, string_agg(DISTINCT e.country_code, ',' ORDER BY e.country_code) AS countries FROM e JOIN f ON e.company_id = f.company_id AND (e.us, e.id) >= f.k AND e.us - f.k[1] < 7 * 86400000000 GROUP BY ALL)
  SELECT company_id, first_id, {ts('make_timestamp(us)')} AS burst_start, event_count, countries, round(0.3 + CASE WHEN event_count >= 10 THEN 0.35 WHEN event_count >= 5 THEN 0.25 ELSE 0.15 END + 0.1, 2)::DOUBLE AS confidence FROM c""".replace(
    "f.k[2]", "f.k.id").replace("f.k[1]", "f.k.us").replace("min((us, id))", "min({'us': us, 'id': id})").replace("(e.us, e.id) >= f.k ", "{'us': e.us, 'id': e.id} >= f.k ")


@query("company_bursts", "W1", BURST)
def _(spark, sf):
    return w.company_bursts(B.incidents(spark, sf).where(F.col("event_type").isin(V.THEFT_TYPES)), min_events=4, days=6)


BAND = "CASE WHEN h >= 22 OR h < 4 THEN 'night_22_04' WHEN h >= 6 AND h < 10 THEN 'morning_06_10' WHEN h >= 10 AND h < 16 THEN 'day_10_16' WHEN h >= 16 AND h < 22 THEN 'evening_16_22' END"


@query("time_patterns", "W2,C7", f"""SELECT dayname(date_occurred) AS day_of_week, {BAND} AS time_window, count(*) AS event_count, string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS countries,
  round(0.3 + CASE WHEN count(*) >= 10 THEN 0.35 WHEN count(*) >= 5 THEN 0.25 ELSE 0.15 END + 0.1, 2)::DOUBLE AS confidence
  FROM (SELECT *, hour(date_occurred) AS h FROM incident WHERE event_type IN ({THEFT})) WHERE {BAND} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, sf):
    return w.time_patterns(B.incidents(spark, sf))


@query("dedup_first", "W8", "SELECT source_url, id FROM incident WHERE source_url IS NULL UNION ALL SELECT source_url, id FROM (SELECT source_url, id, row_number() OVER (PARTITION BY source_url ORDER BY date_collected, id) AS rn FROM incident WHERE source_url IS NOT NULL) WHERE rn = 1")
def _(spark, sf):
    return w.dedup_first(B.incidents(spark, sf), "source_url", [F.asc("date_collected"), F.asc("id")]).select("source_url", "id")


@query("mode_per_country", "W4,W3", mode_sql("country_code", "event_type").replace(" AS v", " AS top_type"))
def _(spark, sf):
    from cordon.operators.sizes import mode_of

    return mode_of(B.incidents(spark, sf), ["country_code"], "event_type", "top_type", "n")


@query("top_tags_per_region", "W4", f"""SELECT region, string_agg(tag, ',' ORDER BY rn) AS tags FROM (SELECT region, tag, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, tag) AS rn
  FROM (SELECT region, unnest(tags) AS tag FROM incident WHERE region IS NOT NULL) GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1""")
def _(spark, sf):
    from cordon.operators.sizes import top_values

    return top_values(B.incidents(spark, sf).where("region is not null").select("region", F.explode("tags").alias("tag")), ["region"], "tag", 3, "tags")



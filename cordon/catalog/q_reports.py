"""Report tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import case, half, sev, ts
from cordon.catalog.q_stats import FIN, PLACE, THEFT, mode_sql
from cordon.catalog.registry import query
from cordon.operators import joins as j
from cordon.plans import reports as r
from cordon.refdata import fixed as V
from cordon.sources.ingest_rows import report_record

SIG = "((trust_score >= 0.2 AND trust_score <= 0.79) OR (NOT is_official AND trust_score > 0))"
CONF = "(trust_score >= 0.8 AND is_official)"


@query("report_confirmed", "R1", f"SELECT id, country_code, event_type, upper(severity) AS severity, concat_ws(', ', city, region, country_code) AS location, company_name AS company FROM incident WHERE {CONF}")
def _(spark, sf):
    return r.confirmed(B.incidents(spark, sf)).select("id", "country_code", "event_type", "severity", "location", "company")


@query("report_signals", "R2", f"SELECT id, {ts('date_occurred')} AS date_occurred, 'Transport company in ' || coalesce(region, country_code) AS company FROM incident WHERE {SIG}")
def _(spark, sf):
    return r.signals(B.incidents(spark, sf)).select("id", "date_occurred", "company")


@query("report_financial", "R3", f"SELECT id, event_type, CASE WHEN is_official THEN company_name ELSE '' END AS company, CASE event_type WHEN 'bankruptcy' THEN 0 WHEN 'restructuring' THEN 1 WHEN 'payment_issue' THEN 2 ELSE 3 END AS section FROM incident WHERE event_type IN ({FIN})")
def _(spark, sf):
    return r.financial(B.incidents(spark, sf)).select("id", "event_type", "company", "section")


@query("report_risk_map", "R4", f"""WITH p AS (SELECT *, {PLACE} AS place FROM incident) SELECT p.place, count(*) AS event_count, {half('avg(' + sev() + ')', 2)} AS severity_avg, round(avg(latitude), 4) AS latitude, round(avg(longitude), 4) AS longitude, any_value(m.v) AS top_type
  FROM p JOIN ({mode_sql('place', 'event_type', 'p')}) m ON m.place = p.place GROUP BY 1""")
def _(spark, sf):
    return r.risk_map(B.incidents(spark, sf)).drop("description")


@query("report_by_country", "R6", """WITH t AS (SELECT country_code, string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type || '=') AS types FROM (SELECT country_code, event_type, count(*) AS n FROM incident GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT country_code, string_agg(sv || '=' || CAST(n AS VARCHAR), ',' ORDER BY sv) AS severities FROM (SELECT country_code, upper(severity) AS sv, count(*) AS n FROM incident GROUP BY 1, 2) GROUP BY 1)
  SELECT a.country_code, a.n, t.types, s.severities FROM (SELECT country_code, count(*) AS n FROM incident GROUP BY 1) a JOIN t USING (country_code) JOIN s USING (country_code)""")
def _(spark, sf):
    return r.by_country(B.incidents(spark, sf))


@query("report_recommendations", "R7", f"""SELECT * FROM (SELECT 'night_security' AS rule, {PLACE} AS subject, count(*) AS n FROM incident WHERE event_type IN ({THEFT}) GROUP BY 2 ORDER BY n DESC, 2 LIMIT 3) WHERE n >= 3
  UNION ALL SELECT 'fuel_theft', string_agg(DISTINCT country_code, ', ' ORDER BY country_code), count(*) FROM incident WHERE event_type = 'theft_fuel' HAVING count(*) >= 5
  UNION ALL SELECT * FROM (SELECT 'company_diligence', company_name, count(*) AS n FROM incident WHERE event_type IN ('bankruptcy', 'restructuring', 'payment_issue') GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3) WHERE n >= 2
  UNION ALL SELECT 'corridor_monitoring', corridor, count(*) FROM incident i JOIN corridor_segment s ON i.country_code = s.cc AND i.road = s.road GROUP BY 2 HAVING count(DISTINCT i.country_code) >= 2
  UNION ALL SELECT 'schedule', dayname(date_occurred) || ' ' || b, count(*) FROM (SELECT *, CASE WHEN h >= 22 OR h < 4 THEN 'night_22_04' WHEN h >= 6 AND h < 10 THEN 'morning_06_10' WHEN h >= 10 AND h < 16 THEN 'day_10_16' WHEN h >= 16 AND h < 22 THEN 'evening_16_22' END AS b
    FROM (SELECT *, hour(date_occurred) AS h FROM incident WHERE event_type IN ({THEFT}))) WHERE b IS NOT NULL GROUP BY 2 HAVING count(*) >= 3""")
def _(spark, sf):
    return r.recommendations(B.incidents(spark, sf), j.segments(spark))


ACT = " UNION ALL ".join(f"SELECT '{f}' AS family, {s} AS step, '{a}' AS action" for f, s, a in r.ACTIONS)
FAM = "CASE WHEN event_type LIKE 'theft%' THEN 'theft' WHEN event_type IN ('bankruptcy', 'restructuring', 'payment_issue') THEN 'financial' WHEN event_type = 'license_revoked' THEN 'license' WHEN event_type IN ('route_closure', 'delay') THEN 'route' WHEN event_type = 'strike' THEN 'strike' ELSE 'other' END"


@query("alert_actions", "R8", f"""WITH a AS ({ACT}), e AS (SELECT al.id, i.event_type, al.severity, {FAM} AS fam FROM alert al JOIN incident i ON i.id = al.id), f AS (SELECT id, fam AS family FROM e UNION ALL SELECT id, 'theft_critical' FROM e WHERE fam = 'theft' AND severity = 'critical')
  SELECT f.id, CAST(a.step AS INTEGER) AS step, a.action FROM f JOIN a USING (family) UNION ALL SELECT id, 9, 'Note: 3 related event(s) detected. This may indicate a broader pattern.' FROM e""")
def _(spark, sf):
    kinds = B.incidents(spark, sf).select("id", "event_type")
    return r.alert_actions(B.alerts(spark, sf).join(kinds, "id"))


@query("report_record", "S21", f"""SELECT 'biweekly' AS report_type, '2024-01-15' AS period_start, '2024-01-29' AS period_end, 'PL,DE' AS countries, count(*) AS total_events, count(*) FILTER ({CONF}) AS confirmed_events, count(*) FILTER ({SIG}) AS signal_events, 'generated' AS status
  FROM incident WHERE country_code IN ('PL', 'DE') AND date_occurred >= TIMESTAMP '2024-01-15' AND date_occurred < TIMESTAMP '2024-01-29'""")
def _(spark, sf):
    i = B.incidents(spark, sf).where("country_code in ('PL', 'DE') and date_occurred >= timestamp_ntz'2024-01-15' and date_occurred < timestamp_ntz'2024-01-29'")
    return report_record(i, "biweekly", "2024-01-15", "2024-01-29", ["PL", "DE"])


@query("report_tables", "R9")
def _(spark, sf):
    t = r.report_tables(B.incidents(spark, sf), B.companies(spark, sf), "sales", "2024-01-15 00:00:00", "2024-01-29 00:00:00", ["PL", "DE", "FR"])
    return reduce(DataFrame.unionByName, [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("part"), "rows") for n, d in t.items()])


LAB = case("event_type", V.MESSAGE_LABELS, "upper(replace(event_type, '_', ' '))")


@query("message_text", "R10", f"""SELECT id, concat_ws(chr(10), CASE WHEN intelligence_tier = 1 THEN '\U0001f6a8 ' ELSE '⚠️ ' END || '**' || {LAB} || '** | ' || {case('country_code', V.COUNTRY_NAMES, 'country_code')} || chr(10), '\U0001f4cd ' || coalesce(location_detail, city, region),
  '\U0001f4c5 ' || strftime(date_occurred, '%d.%m.%Y %H:%M'), '\U0001f4dd ' || description, '\U0001f50d MO: ' || modus_operandi, '\U0001f4e6 Cargo: ' || cargo_type, '⚠️ Source: ' || source_name) AS message FROM incident""")
def _(spark, sf):
    return r.message_text(B.incidents(spark, sf).withColumn("financial_impact_eur", F.lit(None).cast("double")))

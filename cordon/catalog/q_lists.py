"""Scans, lists, look-ups, projections, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import arr, case, iso, ts
from cordon.catalog.registry import query
from cordon.operators import filters as f
from cordon.operators import joins as j
from cordon.refdata import fixed as V
from cordon.sources.stored import attach

ACTION = "(intelligence_tier <= 2 OR intelligence_tier IS NULL)"


@query("incidents_with_source_and_company", "S1,J1", """SELECT i.id, i.event_type, s.name AS source_label, s.is_official AS source_official, c.name AS company_label, c.financial_status
  FROM incident i LEFT JOIN source s ON i.source_id = s.id LEFT JOIN company c ON i.company_id = c.id""")
def _(spark, sf):
    return attach(B.incidents(spark, sf), B.sources(spark, sf), B.companies(spark, sf)).select(
        "id", "event_type", "source_label", "source_official", "company_label", "financial_status")


@query("event_list", "F1,W6", f"""SELECT id, country_code, event_type, severity, {ts('date_occurred')} AS date_occurred, trust_score FROM incident
  WHERE country_code = 'DE' AND trust_score >= 0.5 AND is_verified AND date_occurred >= TIMESTAMP '2024-01-03' AND date_occurred <= TIMESTAMP '2024-01-25' AND {ACTION}
  ORDER BY incident.date_occurred DESC, id DESC LIMIT 50 OFFSET 20""")
def _(spark, sf):
    return f.event_list(B.incidents(spark, sf), 50, 20, country="de", trust_min=0.5, verified=True, date_from="2024-01-03", date_to="2024-01-25").select(
        "id", "country_code", "event_type", "severity", "date_occurred", "trust_score")


@query("event_total", "F1", "SELECT count(*) AS total FROM incident WHERE severity = 'high' AND intelligence_tier <= 3")
def _(spark, sf):
    return f.event_total(B.incidents(spark, sf), severity="HIGH", tier_max=3)


@query("company_list", "F2", "SELECT id, name, country_code, company_type, financial_status, risk_score FROM company WHERE country_code = 'DE' AND risk_score >= 20 ORDER BY risk_score DESC, id LIMIT 50")
def _(spark, sf):
    return f.company_list(B.companies(spark, sf), country="de", risk_min=20).select("id", "name", "country_code", "company_type", "financial_status", "risk_score")


@query("companies_at_risk", "F3", f"SELECT id, name, financial_status, risk_score FROM company WHERE financial_status IN ({str(V.AT_RISK_STATUSES)[1:-1]})")
def _(spark, sf):
    return f.at_risk(B.companies(spark, sf)).select("id", "name", "financial_status", "risk_score")


@query("companies_at_risk_top", "F3", f"SELECT id, name, country_code, risk_score FROM company WHERE financial_status IN ({str(V.AT_RISK_STATUSES)[1:-1]}) AND country_code IN ('PL','DE') ORDER BY risk_score DESC, id LIMIT 20")
def _(spark, sf):
    return f.at_risk(B.companies(spark, sf), ["pl", "de"], 20).select("id", "name", "country_code", "risk_score")


@query("alert_list", "F4", f"SELECT id, severity, {arr('country_codes')} AS country_codes, {ts('triggered_at')} AS triggered_at FROM alert WHERE is_active AND severity = 'high' AND list_contains(country_codes, 'PL')")
def _(spark, sf):
    return f.alert_list(B.alerts(spark, sf), active=True, severity="High", country="pl").select("id", "severity", "country_codes", "triggered_at")


@query("report_list", "F5", f"""SELECT id, report_type, status, {ts('created_at')} AS created_at FROM report
  WHERE report_type = 'monthly' AND {iso('created_at')} >= '1996-01-01' AND {iso('created_at')} <= '1997-01-01T00:00:00Z'""")
def _(spark, sf):
    return f.report_list(B.reports(spark, sf), "monthly", None, "1996-01-01", "1997-01-01T00:00:00Z").select("id", "report_type", "status", "created_at")


@query("subscriber_list", "F6", "SELECT id, company_name, subscription_tier FROM subscriber WHERE is_active")
def _(spark, sf):
    return f.subscriber_list(B.subscribers(spark, sf)).select("id", "company_name", "subscription_tier")


@query("event_by_id", "F7", "SELECT id, title, severity FROM incident WHERE id = 77")
def _(spark, sf):
    return f.by_id(B.incidents(spark, sf), 77).select("id", "title", "severity")


@query("company_history", "F8", f"SELECT id, event_type, {ts('date_occurred')} AS date_occurred FROM incident WHERE company_id = 3 ORDER BY incident.date_occurred DESC, id DESC LIMIT 30")
def _(spark, sf):
    return f.company_history(B.incidents(spark, sf), 3, 30).select("id", "event_type", "date_occurred")


@query("latest_events_per_company", "F8,W4", """SELECT company_id, id, CAST(rn AS INTEGER) AS rn FROM (SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY date_occurred DESC, id DESC) AS rn FROM incident) WHERE rn <= 30""")
def _(spark, sf):
    return f.latest_per_company(B.incidents(spark, sf), 30).select("company_id", "id", "rn")


@query("latest_financials_per_company", "F8", """SELECT company_id, id, event_type, CAST(rn AS INTEGER) AS rn FROM (SELECT company_id, id, event_type, row_number() OVER (PARTITION BY company_id ORDER BY date_occurred DESC, id DESC) AS rn FROM financial) WHERE rn <= 20""")
def _(spark, sf):
    return f.latest_per_company(B.financials(spark, sf), 20).select("company_id", "id", "event_type", "rn")


@query("present_events", "F9", f"""SELECT id, upper(severity) AS severity, CASE WHEN region IS NOT NULL OR city IS NOT NULL THEN coalesce(region, '-') || '/' || coalesce(city, '-') END AS place,
  {iso('date_occurred')} AS date, trust_score, is_official, {arr('tags')} AS tags FROM incident""")
def _(spark, sf):
    p = f.present_events(B.incidents(spark, sf))
    place = F.when(F.col("location").isNotNull(), F.concat(F.coalesce("location.region", F.lit("-")), F.lit("/"), F.coalesce("location.city", F.lit("-"))))
    return p.select("id", "severity", place.alias("place"), "date", "trust_score", "is_official", "tags")


@query("present_companies", "F9", "SELECT id, name, country_code, company_type, upper(financial_status) AS financial_status, risk_score FROM company")
def _(spark, sf):
    return f.present_companies(B.companies(spark, sf))


@query("present_alerts", "F9", f"SELECT id, alert_type, upper(severity) AS severity, title, country_codes[1] AS country_code, is_active, {iso('triggered_at')} AS created_at, {iso('resolved_at')} AS resolved_at, {arr('related_event_ids')} AS related_event_ids FROM alert")
def _(spark, sf):
    return f.present_alerts(B.alerts(spark, sf))


@query("present_hotspots", "F9", "SELECT latitude, longitude, event_count, upper(severity) AS severity, hotspot_type AS event_type, radius_km, region AS label FROM hotspot")
def _(spark, sf):
    return f.present_hotspots(B.stored_hotspots(spark, sf))


@query("agent_log", "F10", f"""SELECT * FROM (
  SELECT {iso('last_heartbeat')} AS timestamp, country_code, agent_type, 'ERROR' AS level, last_error AS message FROM agent WHERE status = 'error' AND coalesce(last_error, '') <> ''
  UNION ALL SELECT {iso('last_heartbeat')}, country_code, agent_type, 'INFO', 'Collected ' || CAST(events_collected_today AS VARCHAR) || ' events today.' FROM agent WHERE status = 'running' AND events_collected_today > 0)
  ORDER BY timestamp DESC, country_code, agent_type LIMIT 100""")
def _(spark, sf):
    return f.agent_log(B.agent_status(spark, sf), B.AS_OF)


@query("change_feed", "F11", f"""SELECT 'alert' AS kind, id, alert_type AS type, severity, title, {ts('triggered_at')} AS at FROM alert
   WHERE triggered_at >= TIMESTAMP '2024-01-20' AND list_has_any(country_codes, ['PL','DE'])
  UNION ALL SELECT * FROM (SELECT 'event', id, event_type, severity, title, {ts('date_occurred')} FROM incident WHERE date_occurred >= TIMESTAMP '2024-01-20' AND country_code IN ('PL','DE') ORDER BY incident.date_occurred DESC, id DESC LIMIT 200)""")
def _(spark, sf):
    return f.change_feed(B.alerts(spark, sf), B.incidents(spark, sf), "2024-01-20 00:00:00", ["pl", "de"])


HOST = "regexp_replace(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE regexp_extract(url, '^([^?#]*)', 1) END, '^www\\.', '')"


@query("url_policy", "F12", f"""SELECT page_id, host, CASE WHEN host = 'm.ththth.example.net' THEN 'blocked' WHEN host IN ({str(V.ALLOWED_HOSTS)[1:-1]}) THEN 'allowed'
  WHEN host IN ({str(V.LOGIN_HOSTS)[1:-1]}) THEN 'login' WHEN host IN ({str(V.PAYWALL_HOSTS)[1:-1]}) THEN 'paywall' ELSE 'ok' END AS url_verdict
  FROM (SELECT page_id, {HOST} AS host FROM pages)""")
def _(spark, sf):
    p = B.table(spark, sf, "pages").select("page_id", "url")
    return f.url_policy(p, blocked=["m.ththth.example.net"], url="url").select("page_id", "host", "url_verdict")


CH = case("event_type", V.CHANNEL_OF_TYPE, "CASE WHEN event_type = 'damage' AND intelligence_category IN ('curtain_slashing', 'dangerous_parking') THEN 'unsafe-parkings' ELSE 'road-warnings' END")


@query("route_channels", "F21", f"""SELECT id, unnest([{CH}, CASE WHEN country_code IN ('PL','DE','FR') THEN 'country-' || lower(country_code) ELSE 'country-other' END]) AS channel FROM incident""")
def _(spark, sf):
    return f.route_channels(B.incidents(spark, sf), ["country-pl", "country-de", "country-fr"]).select("id", "channel")


@query("screen_sources", "F22", f"""WITH cand AS (SELECT c_custkey AS seen, CASE WHEN c_custkey % 3 > 0 THEN 'Chan' || CAST(c_custkey // 2 AS VARCHAR) ELSE '' END AS username, 'Title ' || CAST(c_custkey // 6 AS VARCHAR) AS title, CAST(round(abs(c_acctbal)) AS BIGINT) % 200 AS participants FROM customer),
  big AS (SELECT *, CASE WHEN username <> '' THEN '@' || lower(username) ELSE lower(title) END AS k FROM cand WHERE participants >= 50 AND (username = '' OR lower(username) NOT IN (SELECT 'chan' || CAST(s_suppkey AS VARCHAR) FROM supplier)))
  SELECT seen AS seen_order, username, title, participants, CASE WHEN username <> '' THEN 'public' ELSE 'private' END AS visibility FROM big QUALIFY row_number() OVER (PARTITION BY k ORDER BY seen) = 1""")
def _(spark, sf):
    cand = B.table(spark, sf, "customer").selectExpr(
        "c_custkey as seen_order", "case when c_custkey % 3 > 0 then concat('Chan', cast(c_custkey div 2 as string)) else '' end as username",
        "concat('Title ', cast(c_custkey div 6 as string)) as title", "cast(round(abs(c_acctbal)) as bigint) % 200 as participants")
    known = B.table(spark, sf, "supplier").selectExpr("concat('CHAN', cast(s_suppkey as string)) as username")
    return f.screen_sources(cand, known).select("seen_order", "username", "title", "participants", "visibility")


@query("monitored_messages", "F23", """SELECT conv_id, turn, 'g' || CAST(conv_id % 7 AS VARCHAR) AS guild_id FROM conversations
  WHERE role <> 'assistant' AND text <> '' AND conv_id % 7 IN (0, 1, 2, 3, 4) AND (conv_id % 7 = 2 OR conv_id % 3 < 2)""")
def _(spark, sf):
    from cordon.refdata.tables import literal

    m = B.table(spark, sf, "conversations").selectExpr(
        "conv_id", "turn", "text", "role = 'assistant' as is_bot", "concat('g', cast(conv_id % 7 as string)) as guild_id", "concat('Chan', cast(conv_id % 3 as string)) as channel")
    rows = [(f"g{g}", [] if g == 2 else ["CHAN0", "chan1"], "en") for g in range(5)]
    return f.monitored(m, literal(spark, rows, "guild_id string, channels array<string>, language string")).select("conv_id", "turn", "guild_id")


@query("alert_events", "J4", "SELECT a.alert_id, i.id, i.event_type FROM (SELECT id AS alert_id, unnest(related_event_ids) AS eid FROM alert) a JOIN incident i ON i.id = a.eid")
def _(spark, sf):
    return j.alert_events(B.alerts(spark, sf), B.incidents(spark, sf).select("id", "event_type"))


@query("alert_fan_out", "J5", """SELECT a.id AS alert_id, s.id AS subscriber_id FROM alert a JOIN subscriber s ON s.is_active AND s.subscription_tier IN ('premium_alerts', 'enterprise_api')
  AND a.severity IN ('critical', 'high') AND (len(a.country_codes) = 0 OR len(s.subscribed_countries) = 0 OR list_has_any(a.country_codes, s.subscribed_countries))""")
def _(spark, sf):
    return j.fan_out(B.alerts(spark, sf), B.subscribers(spark, sf))


@query("report_fan_out", "J6", """SELECT subscriber_id, count(*) AS reports, sum(report_id)::BIGINT AS id_sum FROM (SELECT r.id AS report_id, s.id AS subscriber_id FROM report r JOIN subscriber s ON s.is_active
  AND (len(r.countries) = 0 OR len(s.subscribed_countries) = 0 OR list_has_any(r.countries, s.subscribed_countries))) GROUP BY 1""")
def _(spark, sf):
    return j.report_counts(B.reports(spark, sf), B.subscribers(spark, sf))


@query("vat_check", "J12", """SELECT req_id, coalesce(country_code, '') AS country_code, coalesce(vat_number, '') AS vat_number, coalesce(v, false) AS valid, coalesce(company_name, '') AS company_name,
  CASE WHEN coalesce(vat_number, '') = '' THEN 'Missing country_code or vat_number' END AS error
  FROM (SELECT r.req_id, r.country_code, CAST(CASE WHEN r.req_id % 3 = 0 THEN r.req_id END AS VARCHAR) AS vat_number FROM request r) q LEFT JOIN (SELECT country_code, vat_number, valid AS v, company_name FROM vat) v USING (country_code, vat_number)""")
def _(spark, sf):
    q = B.requests(spark, sf).selectExpr("req_id", "country_code", "case when req_id % 3 = 0 then cast(req_id as string) end as vat_number")
    return j.vat_check(q, B.vat_table(spark, sf))



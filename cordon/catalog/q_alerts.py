"""Alert rules at one moment and over every window; hotspot refresh; publishing."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import arr, ts
from cordon.catalog.registry import query
from cordon.operators import alerts as a
from cordon.session import shared_table

NOW = "2024-01-20 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def last(span: str, col: str = "date_collected") -> str:
    return f"{col} >= {NOW_SQL} - INTERVAL {span} AND {col} <= {NOW_SQL}"


def slide(minutes: int, step: int, keys: str, extra: str = "") -> str:
    """All epoch-aligned sliding windows an event falls in, counted per key."""
    n = minutes // step
    return f"""SELECT make_timestamp((epoch_us(date_collected) // {step * 60_000_000} - k) * {step * 60_000_000}) AS win_start, {keys}, count(*) AS n
      FROM incident CROSS JOIN (SELECT unnest(range({n})) AS k) WHERE true {extra} GROUP BY ALL"""


CRIT = f"""SELECT * FROM incident WHERE severity = 'critical' AND id NOT IN (SELECT unnest(related_event_ids) FROM alert WHERE alert_type = 'theft_spike')"""


@query("critical_alerts_all", "A18,X7", f"""SELECT 'theft_spike' AS alert_type, 'critical' AS severity, 'CRITICAL event: ' || title AS title, country_code AS country_codes, region, true AS is_active,
  {ts('date_collected')} AS triggered_at, CAST(id AS VARCHAR) AS related_event_ids FROM ({CRIT})""")
def _(spark, sf):
    return a.critical_all(B.incidents(spark, sf), B.alerts(spark, sf))


@query("critical_alerts_at", "A18", f"""SELECT 'theft_spike' AS alert_type, 'critical' AS severity, 'CRITICAL event: ' || title AS title, country_code AS country_codes, region, true AS is_active,
  '{NOW}.000000' AS triggered_at, CAST(id AS VARCHAR) AS related_event_ids FROM ({CRIT}) WHERE {last('30 MINUTE')}""")
def _(spark, sf):
    return a.critical_alerts(B.incidents(spark, sf), B.alerts(spark, sf), NOW)


@query("spike_alerts_at", "A17", f"""WITH r AS (SELECT *, coalesce(region, 'unknown') AS reg FROM incident WHERE {last('30 MINUTE')}),
  g AS (SELECT country_code, reg, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
  cov AS (SELECT unnest(country_codes) AS cc FROM alert WHERE alert_type = 'theft_spike' AND is_active AND {last('30 MINUTE', 'triggered_at')} UNION SELECT country_code FROM ({CRIT}) WHERE {last('30 MINUTE')}),
  o AS (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY n DESC, reg) AS rn FROM g WHERE country_code NOT IN (SELECT cc FROM cov)),
  ids AS (SELECT country_code, reg, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS l FROM (SELECT country_code, reg, id, row_number() OVER (PARTITION BY country_code, reg ORDER BY id) AS k FROM r) WHERE k <= 10 GROUP BY 1, 2)
  SELECT 'theft_spike' AS alert_type, 'high' AS severity, 'Spike: ' || CAST(n AS VARCHAR) || ' events in ' || o.country_code || '/' || o.reg AS title, o.country_code AS country_codes, nullif(o.reg, 'unknown') AS region,
  true AS is_active, '{NOW}.000000' AS triggered_at, ids.l AS related_event_ids FROM o JOIN ids ON o.country_code = ids.country_code AND o.reg = ids.reg WHERE rn = 1""")
def _(spark, sf):
    return a.spike_alerts(B.incidents(spark, sf), B.alerts(spark, sf), NOW, min_events=2)


@query("spike_windows", "A17,X3", f"""WITH w AS ({slide(30, 5, "country_code, coalesce(region, 'unknown') AS region")})
  SELECT {ts('win_start')} AS win_start, {ts('win_start + INTERVAL 30 MINUTE')} AS win_end, country_code, region, n FROM w WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY w.win_start, country_code ORDER BY n DESC, region) = 1""")
def _(spark, sf):
    return a.spike_windows(B.incidents(spark, sf))


@query("burst_windows", "A19,X4", f"""WITH w AS ({slide(120, 30, 'country_code, event_type')}), b AS (SELECT * FROM w WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY w.win_start, country_code ORDER BY n DESC, event_type) = 1)
  SELECT {ts('win_start')} AS win_start, {ts('win_start + INTERVAL 2 HOUR')} AS win_end, country_code, event_type, n, least(0.9, round(0.3 + n * 0.1, 2))::DOUBLE AS confidence FROM b""")
def _(spark, sf):
    return a.burst_windows(B.incidents(spark, sf))


@query("burst_correlations_at", "A19", f"""WITH r AS (SELECT * FROM incident WHERE {last('2 HOUR')}), g AS (SELECT country_code, event_type, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
  cov AS (SELECT unnest(country_codes) AS cc FROM alert WHERE alert_type = 'theft_spike' AND {last('2 HOUR', 'triggered_at')} AND id % 2 = 0 AND severity = 'medium'),
  o AS (SELECT * FROM g WHERE country_code NOT IN (SELECT cc FROM cov) QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY n DESC, event_type) = 1),
  ids AS (SELECT country_code, event_type, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY country_code, event_type ORDER BY id) AS k FROM r) WHERE k <= 20 GROUP BY 1, 2)
  SELECT 'same_location' AS correlation_type, o.country_code, o.event_type, o.n, ids.l AS event_ids, least(0.9, round(0.3 + o.n * 0.1, 2))::DOUBLE AS confidence, '{NOW}.000000' AS detected_at
  FROM o JOIN ids ON o.country_code = ids.country_code AND o.event_type = ids.event_type""")
def _(spark, sf):
    corr = B.alerts(spark, sf).where("alert_type = 'theft_spike' and severity = 'medium'").select(
        F.lit("same_location").alias("correlation_type"), "country_codes", F.col("triggered_at").alias("detected_at"))
    return a.burst_correlations(B.incidents(spark, sf), corr, NOW, min_events=2)


@query("hotspot_windows", "A20,X5", f"""WITH w AS ({slide(7 * 1440, 1440, 'country_code, region, event_type', 'AND region IS NOT NULL')})
  SELECT {ts('win_start')} AS win_start, {ts('win_start + INTERVAL 7 DAY')} AS win_end, country_code, region, event_type, n FROM w WHERE n >= 5""")
def _(spark, sf):
    return a.hotspot_windows(B.incidents(spark, sf))


REFRESH = f"""WITH g AS (SELECT country_code, region, event_type, count(*) AS n FROM incident WHERE region IS NOT NULL AND {last('7 DAY')} GROUP BY 1, 2, 3 HAVING count(*) >= 5),
  b AS (SELECT country_code, region, max(n) AS n FROM g GROUP BY 1, 2)
  SELECT h.country_code, h.region, coalesce(b.n, h.event_count) AS event_count, CASE WHEN b.n >= 10 THEN 'high' WHEN b.n >= 7 THEN 'medium' ELSE h.severity END AS severity, CASE WHEN b.n >= 10 THEN 'rising' ELSE h.trend END AS trend,
  CASE WHEN b.n IS NOT NULL THEN '{NOW}.000000' ELSE {ts('h.last_calculated')} END AS last_calculated FROM hotspot h LEFT JOIN b ON h.country_code = b.country_code AND h.region = b.region"""


@query("refresh_hotspots", "A20", REFRESH)
def _(spark, sf):
    return a.refresh_hotspots(B.incidents(spark, sf), B.stored_hotspots(spark, sf), NOW).select("country_code", "region", "event_count", "severity", "trend", "last_calculated")


@query("refresh_hotspots_from_days", "A20,X5", REFRESH)
def _(spark, sf):
    inc = B.incidents(spark, sf)
    days = shared_table(a.day_counts(inc), "days", "day")
    return a.refresh_hotspots(inc, B.stored_hotspots(spark, sf), NOW, days=days).select("country_code", "region", "event_count", "severity", "trend", "last_calculated")


@query("publish_queue", "P1,J11", f"""SELECT id, intelligence_tier, {ts('date_collected')} AS date_collected FROM incident WHERE intelligence_tier IN (1, 2) AND {last('24 HOUR')} AND id NOT IN (SELECT id FROM alert)
  ORDER BY intelligence_tier, incident.date_collected DESC, id DESC LIMIT 50""")
def _(spark, sf):
    return a.publish_queue(B.incidents(spark, sf), B.alerts(spark, sf), NOW).select("id", "intelligence_tier", "date_collected")


@query("spike_members_at", "A17", f"""WITH r AS (SELECT *, coalesce(region, 'unknown') AS reg FROM incident WHERE {last('30 MINUTE')}), g AS (SELECT country_code, reg, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2),
  cov AS (SELECT unnest(country_codes) AS cc FROM alert WHERE alert_type = 'theft_spike' AND is_active AND {last('30 MINUTE', 'triggered_at')} UNION SELECT country_code FROM ({CRIT}) WHERE {last('30 MINUTE')}),
  o AS (SELECT * FROM g WHERE country_code NOT IN (SELECT cc FROM cov) QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY n DESC, reg) = 1) SELECT r.country_code, r.reg AS region, r.id FROM r JOIN o ON o.country_code = r.country_code AND o.reg = r.reg""")
def _(spark, sf):
    inc = B.incidents(spark, sf)
    return a.spike_members(inc, a.spike_alerts(inc, B.alerts(spark, sf), NOW, min_events=2), NOW)

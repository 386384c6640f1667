"""Batch twins of the stateful streams."""

from __future__ import annotations

from cordon.catalog import bind as B
from cordon.catalog.oracle import ts
from cordon.catalog.q_alerts import slide
from cordon.catalog.registry import query
from cordon.operators import alerts as a
from cordon.session import as_ts
from cordon.streaming import streams

THR = """WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS us, event_id AS id FROM events), f AS (SELECT k, min(us) AS us FROM e GROUP BY 1),
  kept AS (SELECT k, us FROM f UNION ALL SELECT kept.k, (SELECT min(e.us) FROM e WHERE e.k = kept.k AND e.us >= kept.us + 21600000000) AS us FROM kept WHERE (SELECT min(e.us) FROM e WHERE e.k = kept.k AND e.us >= kept.us + 21600000000) IS NOT NULL)
  SELECT CAST(k.k AS VARCHAR) AS key, k.us, min(e.id) AS id FROM kept k JOIN e ON e.k = k.k AND e.us = k.us GROUP BY 1, 2"""


@query("throttle", "X6", THR)
def _(spark, sf):
    e = B.table(spark, sf, "events").selectExpr("event_id as id", "user_id", "ts")
    return streams.throttle_batch(e, "user_id", "ts", gap_s=6 * 3600, bucket_s=7 * 86400)


ONE = f"""WITH RECURSIVE w AS ({slide(120, 30, 'country_code, event_type')}), b AS MATERIALIZED (SELECT *, win_start + INTERVAL 2 HOUR AS win_end FROM w WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY w.win_start, country_code ORDER BY n DESC, event_type) = 1),
  kept AS (SELECT country_code, min(win_end) AS e FROM b GROUP BY 1 UNION ALL SELECT k.country_code, (SELECT min(b.win_end) FROM b WHERE b.country_code = k.country_code AND b.win_end >= k.e + INTERVAL 2 HOUR) FROM kept k WHERE EXISTS (SELECT 1 FROM b WHERE b.country_code = k.country_code AND b.win_end >= k.e + INTERVAL 2 HOUR))
  SELECT b.country_code, {ts('b.win_start')} AS win_start, {ts('b.win_end')} AS win_end, b.event_type, b.n FROM b JOIN kept k ON k.country_code = b.country_code AND k.e = b.win_end"""


@query("burst_one_per_country", "X4,A19", ONE)
def _(spark, sf):
    return streams.one_per_country(a.burst_windows(B.incidents(spark, sf)), gap_s=7200).select("country_code", "win_start", "win_end", "event_type", "n")


QUIET = f"""WITH b AS (SELECT DISTINCT country_code, source_type AS agent_type, CAST(floor(epoch_us(date_collected) / 1000) AS BIGINT) AS ms FROM incident), n AS (SELECT *, lead(ms) OVER (PARTITION BY country_code, agent_type ORDER BY ms) AS nx FROM b)
  SELECT country_code, agent_type, {ts('make_timestamp(ms * 1000)')} AS last_heartbeat FROM n WHERE CASE WHEN nx IS NULL THEN epoch_ms(TIMESTAMP '{B.AS_OF}') >= ms + 300000 ELSE nx - ms > 300000 END"""


@query("silences", "X8,A10", QUIET)
def _(spark, sf):
    beats = B.incidents(spark, sf).selectExpr("country_code", "source_type as agent_type", "date_collected as at")
    return streams.silences(beats, as_ts(B.AS_OF))

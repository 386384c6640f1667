"""Spike, burst and critical alerts; hotspot refresh; publishing queue.

Each look-back rule has two forms: ``…(as_of)`` for one moment, and
``…_windows`` for every window of a table, which is what the streaming form
computes incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.operators.sizes import counts, first_by, id_sample
from cordon.session import as_ts

SPIKE = "theft_spike"


def _since(df: DataFrame, col: str, as_of, text: str) -> DataFrame:
    return df.where((F.col(col) >= as_ts(as_of) - F.expr(f"interval {text}")) & (F.col(col) <= as_ts(as_of)))


def critical_alerts(inc: DataFrame, al: DataFrame, as_of) -> DataFrame:
    """One alert per recent critical event that no spike alert lists yet."""
    hot = _since(inc, "date_collected", as_of, "30 minutes").where(F.col("severity") == "critical")
    return _without_alert(hot, al).select(*_critical_cols(as_ts(as_of)))


def critical_all(inc: DataFrame, al: DataFrame) -> DataFrame:
    """The same over the whole table, each alert at its event's arrival."""
    return _without_alert(inc.where(F.col("severity") == "critical"), al).select(*_critical_cols(F.col("date_collected")))


def _without_alert(inc: DataFrame, al: DataFrame) -> DataFrame:
    known = al.where(F.col("alert_type") == SPIKE).select(F.explode("related_event_ids").alias("id")).distinct()
    return inc.join(known, "id", "left_anti")


def _critical_cols(at):
    return [
        F.lit(SPIKE).alias("alert_type"), F.lit("critical").alias("severity"),
        F.concat(F.lit("CRITICAL event: "), "title").alias("title"),
        F.array("country_code").alias("country_codes"), F.col("region"), F.lit(True).alias("is_active"),
        at.alias("triggered_at"), F.array("id").alias("related_event_ids"),
    ]


def spike_members(inc: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """``(country_code, region, id)``: every incident behind the alerts that ``spike_alerts`` gives for a moment, as
    rows, so that none is left out however many there are."""
    recent = _since(inc, "date_collected", as_of, "30 minutes").select(F.coalesce("region", F.lit("unknown")).alias("region"), "country_code", "id")
    of = alerts.select(F.explode("country_codes").alias("country_code"), F.coalesce("region", F.lit("unknown")).alias("region"))
    return recent.join(of, ["country_code", "region"]).select("country_code", "region", "id")


def burst_members(inc: DataFrame, correlations: DataFrame, as_of) -> DataFrame:
    """``(country_code, event_type, id)``: every incident behind ``burst_correlations``."""
    keys = ["country_code", "event_type"]
    return _since(inc, "date_collected", as_of, "2 hours").select(*keys, "id").join(correlations.select(*keys), keys)


def spike_alerts(inc: DataFrame, al: DataFrame, as_of, min_events: int = 3, max_ids: int = 10) -> DataFrame:
    """Country/region groups with enough events in 30 minutes; at most one alert
    per country, and none where an active spike alert (also one the critical rule
    raises now) already covers the country. The row lists the ``max_ids`` smallest ids;
    ``spike_members`` gives them all."""
    recent = _since(inc, "date_collected", as_of, "30 minutes").withColumn("region", F.coalesce("region", F.lit("unknown")))
    groups = counts(recent, ["country_code", "region"]).where(F.col("n") >= min_events)
    covered = _since(al.where((F.col("alert_type") == SPIKE) & F.col("is_active")), "triggered_at", as_of, "30 minutes")
    covered = covered.select(F.explode("country_codes").alias("country_code")).unionByName(
        critical_alerts(inc, al, as_of).select(F.explode("country_codes").alias("country_code"))
    ).distinct()
    free = groups.join(covered, "country_code", "left_anti")
    one = first_by(free, ["country_code"], [F.desc("n"), F.asc("region")])
    ids = id_sample(recent.join(one.select("country_code", "region"), ["country_code", "region"], "left_semi"), ["country_code", "region"], "id", max_ids, "related_event_ids")
    return one.join(ids, ["country_code", "region"]).select(
        F.lit(SPIKE).alias("alert_type"), F.lit("high").alias("severity"),
        F.format_string("Spike: %d events in %s/%s", F.col("n"), F.col("country_code"), F.col("region")).alias("title"),
        F.array("country_code").alias("country_codes"), F.nullif(F.col("region"), F.lit("unknown")).alias("region"),
        F.lit(True).alias("is_active"), as_ts(as_of).alias("triggered_at"), "related_event_ids",
    )


def spike_windows(inc: DataFrame, min_events: int = 3, length: str = "30 minutes", step: str = "5 minutes") -> DataFrame:
    """Per window and country, the busiest region with enough events."""
    src = inc.select("date_collected", "country_code", F.coalesce("region", F.lit("unknown")).alias("region"))
    w = F.window("date_collected", length, step)
    n = src.groupBy(w.alias("w"), "country_code", "region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events)
    best = n.groupBy("w", "country_code").agg(F.min_by(F.struct("region", "n"), F.struct(-F.col("n"), "region")).alias("b"))
    return best.select(
        F.col("w.start").cast("timestamp_ntz").alias("win_start"), F.col("w.end").cast("timestamp_ntz").alias("win_end"),
        "country_code", F.col("b.region").alias("region"), F.col("b.n").alias("n"),
    )


def burst_correlations(inc: DataFrame, corr: DataFrame, as_of, min_events: int = 3, max_ids: int = 20) -> DataFrame:
    """Country/type groups with enough events in two hours, one per country, that
    no fresh correlation covers. ``burst_members`` gives all ids behind a row."""
    recent = _since(inc, "date_collected", as_of, "2 hours")
    groups = counts(recent, ["country_code", "event_type"]).where(F.col("n") >= min_events)
    covered = _since(corr.where(F.col("correlation_type") == "same_location"), "detected_at", as_of, "2 hours").select(
        F.explode("country_codes").alias("country_code")
    ).distinct()
    one = first_by(groups.join(covered, "country_code", "left_anti"), ["country_code"], [F.desc("n"), F.asc("event_type")])
    keys = ["country_code", "event_type"]
    ids = id_sample(recent.join(one.select(*keys), keys, "left_semi"), keys, "id", max_ids, "event_ids")
    return one.join(ids, keys).select(
        F.lit("same_location").alias("correlation_type"), "country_code", "event_type", "n", "event_ids",
        burst_confidence().alias("confidence"), as_ts(as_of).alias("detected_at"),
    )


def burst_confidence():
    return F.least(F.lit(0.9), F.round(0.3 + F.col("n") * 0.1, 2))


def burst_windows(inc: DataFrame, min_events: int = 3, length: str = "2 hours", step: str = "30 minutes") -> DataFrame:
    """Per window and country, the busiest type with enough events."""
    w = F.window("date_collected", length, step)
    n = (
        inc.select("date_collected", "country_code", "event_type")
        .groupBy(w.alias("w"), "country_code", "event_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events)
    )
    best = n.groupBy("w", "country_code").agg(F.min_by(F.struct("event_type", "n"), F.struct(-F.col("n"), "event_type")).alias("b"))
    return best.select(
        F.col("w.start").cast("timestamp_ntz").alias("win_start"), F.col("w.end").cast("timestamp_ntz").alias("win_end"),
        "country_code", F.col("b.event_type").alias("event_type"), F.col("b.n").alias("n"),
    ).withColumn("confidence", burst_confidence())


def hotspot_windows(inc: DataFrame, min_events: int = 5, length: str = "7 days", step: str = "1 day") -> DataFrame:
    """Per window, country/region/type groups with enough events."""
    w = F.window("date_collected", length, step)
    n = (
        inc.where(F.col("region").isNotNull()).select("date_collected", "country_code", "region", "event_type")
        .groupBy(w.alias("w"), "country_code", "region", "event_type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_events)
    )
    return n.select(
        F.col("w.start").cast("timestamp_ntz").alias("win_start"), F.col("w.end").cast("timestamp_ntz").alias("win_end"),
        "country_code", "region", "event_type", "n",
    )


DAY_KEYS = ["country_code", "region", "event_type"]


def day_counts(inc: DataFrame, keys: list[str] | None = None, at: str = "date_collected") -> DataFrame:
    """``(day, keys…, n)``: counts that look-backs of any length are merged from. Rows without a time count nowhere."""
    return counts(inc.where(F.col(at).isNotNull()).withColumn("day", F.to_date(at)), ["day", *(keys or DAY_KEYS)])


def store_days(inc: DataFrame, path: str, keys: list[str] | None = None, at: str = "date_collected") -> None:
    """Write the counts of the days that ``inc`` holds, whole days only, in place of what the store has of these days;
    a day that is written again changes nothing."""
    day_counts(inc, keys, at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def look_back(days: DataFrame, inc: DataFrame, as_of, n_days: int, keys: list[str] | None = None, at: str = "date_collected") -> DataFrame:
    """``(keys…, n)`` over the last ``n_days`` to the moment: days that lie within are taken from their counts, and only
    rows of the two days at the edges are read."""
    keys, now = keys or DAY_KEYS, as_ts(as_of)
    start = now - F.expr(f"interval {int(n_days)} days")
    first, end = F.to_date(start + F.expr("interval 1 day") - F.expr("interval 1 microsecond")), F.to_date(now)
    within = days.where((F.col("day") >= first) & (F.col("day") < end)).select(*keys, "n")
    edges = inc.where((F.col(at) >= start) & (F.col(at) <= now) & ((F.col(at) < first.cast("timestamp_ntz")) | (F.col(at) >= end.cast("timestamp_ntz"))))
    return within.unionByName(counts(edges, keys)).groupBy(*keys).agg(F.sum("n").alias("n"))


def refresh_hotspots(inc: DataFrame, hotspots: DataFrame, as_of, min_events: int = 5, days: DataFrame | None = None) -> DataFrame:
    """Stored hotspots with the week's largest type count; severity and trend move
    at seven and ten. Hotspots without such a group stay as they are. With ``days``
    (``day_counts``), whole days are not read again."""
    if days is not None:
        n = look_back(days, inc, as_of, 7)
    else:
        n = counts(_since(inc, "date_collected", as_of, "7 days"), DAY_KEYS)
    n = n.where(F.col("region").isNotNull() & (F.col("n") >= min_events))
    best = n.groupBy("country_code", "region").agg(F.max("n").alias("_n"))
    j = hotspots.join(best, ["country_code", "region"], "left")
    hit = F.col("_n").isNotNull()
    return (
        j.withColumn("event_count", F.coalesce("_n", "event_count"))
        .withColumn("severity", F.when(F.col("_n") >= 10, "high").when(F.col("_n") >= 7, "medium").otherwise(F.col("severity")))
        .withColumn("trend", F.when(F.col("_n") >= 10, "rising").otherwise(F.col("trend")))
        .withColumn("last_calculated", F.when(hit, as_ts(as_of)).otherwise(F.col("last_calculated")))
        .drop("_n")
    )


def publish_queue(inc: DataFrame, done: DataFrame, as_of, tiers=(1, 2), cap: int = 50) -> DataFrame:
    """Next incidents to publish: fresh, of the wanted tiers, not published yet;
    lower tier first, newest first."""
    fresh = _since(inc, "date_collected", as_of, "24 hours").where(F.col("intelligence_tier").isin(list(tiers)))
    return (
        fresh.join(done.select("id").distinct(), "id", "left_anti")
        .orderBy("intelligence_tier", F.desc("date_collected"), F.desc("id")).limit(cap)
    )

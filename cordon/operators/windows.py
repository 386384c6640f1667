"""Company bursts, time patterns and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordon.functions.score import confidence, hour_window
from cordon.operators.sizes import counts, first_by, top_n
from cordon.refdata import fixed as V
from cordon.session import micros

DAY_US = 86_400_000_000
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def company_bursts(inc: DataFrame, min_events: int = 3, days: int = 30, key: str = "company_id") -> DataFrame:
    """Per company, the first event whose following ``days`` days (elapsed days
    rounded down) hold enough events, with how many there are.

    Only the first ``min_events`` events of each company and day can matter for
    finding it: a day with that many is a burst by its first event. So the ordered
    window sees a bounded number of rows per company and day, whatever the
    company's size; the size of the burst is then an ordinary aggregate."""
    span = (days + 1) * DAY_US
    e = inc.where(F.col(key).isNotNull() & F.col("date_occurred").isNotNull()).select(
        F.col(key), F.col("id"), F.col("country_code"), micros("date_occurred").alias("us"), F.to_date("date_occurred").alias("_day")
    )
    few = top_n(e.select(key, "_day", "us", "id"), [key, "_day"], [F.asc("us"), F.asc("id")], min_events)
    w = Window.partitionBy(key).orderBy("us", "id")
    hits = few.withColumn("_end", F.lead("us", min_events - 1).over(w)).where(F.col("_end") - F.col("us") < span)
    first = hits.groupBy(key).agg(F.min(F.struct("us", "id")).alias("f"))
    first = first.select(key, F.col("f.us").alias("_us"), F.col("f.id").alias("first_id"))
    inside = e.join(first, key).where(
        (F.col("us") - F.col("_us") < span)
        & ((F.col("us") > F.col("_us")) | ((F.col("us") == F.col("_us")) & (F.col("id") >= F.col("first_id"))))
    )
    out = inside.groupBy(key, "first_id", "_us").agg(
        F.count(F.lit(1)).alias("event_count"), F.sort_array(F.collect_set("country_code")).alias("countries")
    )
    return out.select(
        key, "first_id", F.timestamp_micros("_us").cast("timestamp_ntz").alias("burst_start"), "event_count", "countries",
        confidence(F.lit("SAME_COMPANY"), "event_count").alias("confidence"),
    )


def time_patterns(inc: DataFrame, min_events: int = 3) -> DataFrame:
    """Weekday and hour-band groups of thefts."""
    t = inc.where(F.col("event_type").isin(V.THEFT_TYPES) & F.col("date_occurred").isNotNull()).select(
        F.weekday("date_occurred").alias("weekday"), hour_window("date_occurred").alias("time_window"), "country_code"
    ).where(F.col("time_window").isNotNull())
    g = t.groupBy("weekday", "time_window").agg(
        F.count(F.lit(1)).alias("event_count"), F.sort_array(F.collect_set("country_code")).alias("countries")
    ).where(F.col("event_count") >= min_events)
    names = F.array(*map(F.lit, DAY_NAMES))
    return g.select(
        F.element_at(names, F.col("weekday") + 1).alias("day_of_week"), "time_window", "event_count", "countries",
        confidence(F.lit("SAME_TIME_PATTERN"), "event_count").alias("confidence"),
    )


def dedup_first(df: DataFrame, key, order: list) -> DataFrame:
    """First row of each key in order; rows without a key all stay."""
    k = F.col(key) if isinstance(key, str) else key
    d = df.withColumn("_key", k)
    keyed = first_by(d.where(F.col("_key").isNotNull()), ["_key"], order)
    return keyed.unionByName(d.where(F.col("_key").isNull())).drop("_key")


__all__ = ["company_bursts", "time_patterns", "dedup_first", "counts"]

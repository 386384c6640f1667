"""Raw-record contract, catalogue flattening, and the writes into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.text import shortened
from cordon.operators.sizes import first_by


def validate_raw(raw: DataFrame, source_ref: DataFrame) -> DataFrame:
    """Rows with a URL and some text; missing metadata comes from the source's
    configuration ``(source_name, country_code, language, source_type, trust_score,
    is_official)``, joined on the name."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    keep = raw.where(some("source_url") & (some("title") | some("description") | some("raw_text")))
    cols = ["country_code", "language", "source_type", "trust_score", "is_official"]
    ref = source_ref.select("source_name", *[F.col(c).alias(f"_{c}") for c in cols])
    out = keep.join(ref, "source_name", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def flatten_catalogue(cfg: DataFrame, source_type: str | None = None) -> DataFrame:
    """Feeds from ``(country_code, language, feeds map<type, array<struct>>)``: own
    language or the country's, placeholders out, optionally one type."""
    per = cfg.select("country_code", F.col("language").alias("_lang"), F.explode("feeds").alias("source_type", "list"))
    if source_type:
        per = per.where(F.col("source_type") == source_type)
    one = per.select("country_code", "_lang", "source_type", F.explode("list").alias("f"))
    return one.where(~F.coalesce(F.col("f.url"), F.lit("")).startswith("placeholder")).select(
        F.col("f.name").alias("name"), F.col("f.url").alias("url"), F.coalesce("f.trust_score", F.lit(0.5)).alias("trust_score"),
        F.coalesce("f.is_official", F.lit(False)).alias("is_official"), "source_type", F.coalesce("f.language", "_lang").alias("language"), "country_code",
    )


def flatten_channels(flat: DataFrame, nested: DataFrame, country: str | None = None) -> DataFrame:
    """Channels from both layouts: flat rows ``(region, channels)`` where each
    channel names its own country, and nested rows with one country for all."""
    a = flat.select("region", F.explode("channels").alias("c")).select(
        F.col("c.name").alias("name"), F.col("c.channel").alias("channel"), F.coalesce("c.language", F.lit("en")).alias("language"),
        F.coalesce("c.country_code", F.lit("EU")).alias("country_code"), F.col("region").alias("country_name"),
    )
    b = nested.select("region", "country_code", "language", F.explode("channels").alias("c")).select(
        F.col("c.name").alias("name"), F.col("c.channel").alias("channel"), F.coalesce("c.language", "language", F.lit("en")).alias("language"),
        F.coalesce("country_code", F.lit("XX")).alias("country_code"), F.col("region").alias("country_name"),
    )
    out = a.unionByName(b)
    return out.where(F.col("country_code") == country.upper()) if country else out


def insert_new(new: DataFrame, existing: DataFrame, order: list | None = None, title_chars: int | None = None, text_chars: int | None = None) -> DataFrame:
    """Rows to append: first of each URL in the batch, not stored yet; rows without
    a URL always go in. Defaults are filled; texts are cut only to limits that are given."""
    order = order or [F.asc("date_collected"), F.asc("title")]
    url = F.coalesce("source_url", F.lit(""))
    keyed = first_by(new.where(url != ""), ["source_url"], order)
    fresh = keyed.join(existing.where(url != "").select("source_url").distinct(), "source_url", "left_anti")
    out = fresh.unionByName(new.where(url == ""))
    return (
        out.withColumn("title", shortened(F.coalesce(F.nullif("title", F.lit("")), F.lit("Bez tytulu")), title_chars))
        .withColumn("raw_text", shortened(F.coalesce("raw_text", F.lit("")), text_chars))
        .withColumn("severity", F.coalesce("severity", F.lit("medium"))).withColumn("event_type", F.coalesce("event_type", F.lit("other")))
        .withColumn("is_verified", F.lit(False)).withColumn("source_url", F.nullif("source_url", F.lit("")))
    )


def append(df: DataFrame, path: str) -> None:
    """Write new incidents, one folder per collection day."""
    df.withColumn("day", F.to_date("date_collected")).write.mode("append").partitionBy("day").parquet(path)


def upsert_sources(dim: DataFrame, batch: DataFrame, at) -> DataFrame:
    """Source dimension after a batch: new names get a row, known ones their
    counters. ``batch`` is incidents with source metadata."""
    b = batch.groupBy(F.coalesce("source_name", F.lit("Unknown")).alias("name")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("source_type", "country_code", "trust_score", "is_official")).alias("_m")
    )
    j = dim.join(b, "name", "full_outer")
    return j.select(
        "name", F.coalesce("source_type", "_m.source_type").alias("source_type"), F.coalesce("country_code", "_m.country_code").alias("country_code"),
        F.coalesce("trust_score", "_m.trust_score").alias("trust_score"), F.coalesce("is_official", "_m.is_official").alias("is_official"),
        (F.coalesce("total_events_collected", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total_events_collected"),
        F.when(F.col("_n").isNotNull(), at).otherwise(F.col("last_scraped")).alias("last_scraped"),
    )


def upsert_status(dim: DataFrame, runs: DataFrame) -> DataFrame:
    """Agent state after some runs ``(country_code, agent_type, status, events,
    errors, error_message, run_at)``: counters add up, the last status wins, an
    old error stays unless a new one came."""
    k = ["country_code", "agent_type"]
    r = runs.groupBy(*k).agg(
        F.max_by("status", "run_at").alias("_status"), F.max("run_at").alias("_at"), F.sum("events").alias("_ev"), F.sum("errors").alias("_er"),
        F.max_by("error_message", F.when(F.coalesce("error_message", F.lit("")) != "", F.col("run_at"))).alias("_msg"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return dim.join(r, k, "full_outer").select(
        *k, F.coalesce("_status", "status").alias("status"), F.coalesce("_at", "last_heartbeat").alias("last_heartbeat"),
        (zero("events_collected_today") + zero("_ev")).alias("events_collected_today"), (zero("errors_today") + zero("_er")).alias("errors_today"),
        F.coalesce("_msg", "last_error").alias("last_error"),
    )


def report_record(inc: DataFrame, report_type: str, start: str, end: str, countries: list[str]) -> DataFrame:
    """One row of report metadata with its counts."""
    official, trust = F.coalesce("is_official", F.lit(False)), F.coalesce("trust_score", F.lit(0.0))
    confirmed = (trust >= 0.8) & official
    signal = ((trust >= 0.2) & (trust <= 0.79)) | (~official & (trust > 0))
    return inc.agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(confirmed).alias("confirmed_events"), F.count_if(signal).alias("signal_events")
    ).select(
        F.lit(report_type).alias("report_type"), F.lit(start).cast("date").alias("period_start"), F.lit(end).cast("date").alias("period_end"),
        F.array(*map(F.lit, countries)).alias("countries"), "total_events", "confirmed_events", "signal_events", F.lit("generated").alias("status"),
    )

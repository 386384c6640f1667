"""Road alerts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.text import shortened
from cordon.session import as_ts

SCHEMA = (
    "timestamp string, country string, type string, location string, description string, source_channel string, "
    "language string, raw_text string, lat double, lon double"
)


def alert_rows(df: DataFrame, description_chars: int | None = None, text_chars: int | None = None) -> DataFrame:
    """Rows as they are written: fixed fields, texts cut only to limits that are given."""
    return df.select(
        "timestamp", F.coalesce("country", F.lit("XX")).alias("country"), "type", "location", shortened("description", description_chars).alias("description"),
        F.coalesce("source_channel", F.lit("unknown")).alias("source_channel"), "language", shortened("raw_text", text_chars).alias("raw_text"), "lat", "lon",
    )


def write_road_alerts(df: DataFrame, path: str, description_chars: int | None = 500, text_chars: int | None = 2000) -> None:
    """Appends JSON lines. The lengths are those of the file format; None keeps whole texts."""
    alert_rows(df, description_chars, text_chars).write.mode("append").json(path)


def recent(df: DataFrame, as_of, hours: int = 24, country: str | None = None, kind: str | None = None, limit: int | None = 100) -> DataFrame:
    """Alerts of the last hours, newest first; unreadable times are skipped."""
    at = F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz")
    out = df.withColumn("at", at).where(F.col("at") >= as_ts(as_of) - F.expr(f"interval {hours} hours"))
    if country:
        out = out.where(F.upper("country") == country.upper())
    if kind:
        out = out.where(F.col("type") == kind)
    out = out.orderBy(F.desc("at"), F.asc("location"), F.asc("description"))
    return (out.limit(limit) if limit else out).drop("at")


def read_road_alerts(spark, path: str, as_of, **flt) -> DataFrame:
    """Scan of the JSON lines; broken lines are dropped by the reader."""
    return recent(spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path), as_of, **flt)

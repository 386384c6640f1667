"""Patterns that link incidents; one schema for all kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.score import confidence
from cordon.operators.hotspots import location_clusters
from cordon.operators.joins import corridor_events
from cordon.operators.windows import company_bursts, time_patterns

FINANCIAL = ["bankruptcy", "restructuring", "payment_issue"]
OPERATIONAL = ["theft_cargo", "theft_fuel", "theft_vehicle", "damage", "delay"]


def fin_op_companies(inc: DataFrame) -> DataFrame:
    """Companies with both money trouble and operational events."""
    g = inc.where(F.coalesce("company_name", F.lit("")) != "").groupBy(F.lower("company_name").alias("company")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("event_type").isin(FINANCIAL)).alias("financial_events"),
        F.count_if(F.col("event_type").isin(OPERATIONAL)).alias("operational_events"),
        F.sort_array(F.collect_set("country_code")).alias("countries"),
    )
    hit = (F.col("financial_events") > 0) & (F.col("operational_events") > 0)
    return g.where(hit & (F.col("event_count") >= 2)).withColumn("confidence", confidence(F.lit("FINANCIAL_OPERATIONAL"), "event_count"))


def cross_country(inc: DataFrame, segs: DataFrame) -> DataFrame:
    """Corridors with incidents in two countries or more."""
    g = corridor_events(inc, segs).groupBy("corridor").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sort_array(F.collect_set("country_code")).alias("countries"), F.sort_array(F.collect_set("road")).alias("roads"),
    )
    return g.where(F.size("countries") >= 2).withColumn(
        "confidence", confidence(F.lit("CROSS_COUNTRY_ROUTE"), "event_count", F.size("countries"))
    )


def correlate(inc: DataFrame, segs: DataFrame) -> DataFrame:
    """All kinds together: ``(type, subject, event_count, countries, confidence)``."""
    loc = location_clusters(inc).select(
        F.lit("SAME_LOCATION").alias("type"), F.col("seed_id").cast("string").alias("subject"), "event_count", "countries",
        confidence(F.lit("SAME_LOCATION"), "event_count").alias("confidence"),
    )
    named = inc.where(F.coalesce("company_name", F.lit("")) != "").withColumn("_co", F.lower("company_name"))
    pick = lambda d, kind, subject: d.select(F.lit(kind).alias("type"), subject.alias("subject"), "event_count", "countries", "confidence")
    parts = [
        loc,
        pick(company_bursts(named, key="_co"), "SAME_COMPANY", F.col("_co")),
        pick(fin_op_companies(inc), "FINANCIAL_OPERATIONAL", F.col("company")),
        pick(time_patterns(inc), "SAME_TIME_PATTERN", F.concat_ws(" ", "day_of_week", "time_window")),
        pick(cross_country(inc, segs), "CROSS_COUNTRY_ROUTE", F.col("corridor")),
    ]
    return reduce(DataFrame.unionByName, parts)

"""The stored incident table with its source and company attached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(inc: DataFrame, src: DataFrame, co: DataFrame) -> DataFrame:
    """Left joins to the two dimensions; the optimiser picks broadcast by size."""
    s = src.select(F.col("id").alias("source_id"), F.col("name").alias("source_label"), F.col("is_official").alias("source_official"))
    c = co.select(F.col("id").alias("company_id"), F.col("name").alias("company_label"), "financial_status")
    return inc.join(s, "source_id", "left").join(c, "company_id", "left")


def read_incidents(spark, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Incidents from files or a JDBC table."""
    return spark.read.format(fmt).options(**options).load(path) if fmt != "jdbc" else spark.read.format("jdbc").options(**options).load()

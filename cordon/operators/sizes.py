"""Bounded helpers shared by operators: top-n per group, modes, id samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fits(df: DataFrame, rows: int) -> bool:
    """Is the table at most ``rows`` long? Reads no more than it must."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when the table comes in fewer splits than cores, as
    one big row group would otherwise keep text work in one task. Tables of many
    splits, the normal case at scale, are left as they are and never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast hint behind a counted bound; a larger table is left to a
    shuffled join, which the optimiser may still split for skew."""
    return F.broadcast(df) if fits(df, rows) else df


def shuffled(df: DataFrame) -> DataFrame:
    """Keeps a join with a table that grows with the data out of broadcasts. Spark plans them by the size of
    compressed files, and counts many rows made of one as one, so such a table can fill the driver."""
    return df.hint("merge")


def looked_up(df: DataFrame, key: Column, ref: DataFrame, ref_key: str) -> DataFrame:
    """``df`` with the columns of ``ref`` (one row a key) where ``key`` is known, null elsewhere. Rows without a key,
    often most of them, stay spread over the partitions of a shuffled join."""
    apart = F.concat(F.lit("\0"), F.spark_partition_id().cast("string"))
    return df.withColumn("_key", F.coalesce(key, apart)).join(ref.withColumnRenamed(ref_key, "_key"), "_key", "left").drop("_key")


def top_n(df: DataFrame, keys: list, order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows of each group. Spark limits each group before the
    shuffle, so a hot group moves only ``n`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(1)).orderBy(*order)
    if not keys:
        top = df.orderBy(*order).limit(n)
        return top.withColumn(rank, F.row_number().over(w))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_by(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """One row per group: the first in order (deterministic "first seen")."""
    return top_n(df, keys, order, 1, "_rn").drop("_rn")


def counts(df: DataFrame, keys: list, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def mode_of(df: DataFrame, keys: list[str], col: str, out: str, n_out: str | None = None) -> DataFrame:
    """Most frequent value per group; ties go to the smallest value."""
    c = counts(df, [*keys, col], "_n")
    aggs = [F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(out)]
    if n_out:
        aggs.append(F.max("_n").alias(n_out))
    return c.groupBy(*keys).agg(*aggs) if keys else c.agg(*aggs)


def top_values(df: DataFrame, keys: list[str], col: str, n: int, out: str) -> DataFrame:
    """The ``n`` most frequent values per group as an ordered array."""
    c = counts(df, [*keys, col], "_n")
    best = top_n(c, keys, [F.desc("_n"), F.asc(col)], n, "_r")
    item = F.struct("_r", col)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s[col]).alias(out))


def id_sample(df: DataFrame, keys: list[str], id_col: str, n: int, out: str) -> DataFrame:
    """Smallest ``n`` ids per group as a sorted array; never gathers a whole group."""
    best = top_n(df.select(*keys, id_col), keys, [F.asc(id_col)], n, "_r")
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(id_col)).alias(out))


def count_map(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Per group, a map value -> count; bounded by the distinct values."""
    c = counts(df.where(F.col(col).isNotNull()), [*keys, col], "_n")
    return c.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(col), F.col("_n"))))).alias(out)
    )

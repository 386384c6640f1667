"""Session settings and lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", partitions: int = 8, app: str = "cordon") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """Timestamps are naive UTC everywhere; keep session maths the same."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


BATCH_BYTES = 2 << 20  # of rows that Python gets, or gives back, at a time


def small_batches(spark: SparkSession) -> None:
    """Rows with whole texts or pages go to Python in batches of bounded bytes, not of 10,000 rows of any length, so
    that a worker's memory does not depend on how many rows a task has. What Python gives back is bounded by ``frames``:
    Spark's own bound of output fails on a large batch after one without rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key, None)
    if own is None or not 0 < _bytes(own) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def frames(rows, columns: list[str]):
    """Rows as frames of some ``BATCH_BYTES`` of text; none of them is empty."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it. A local session without
    one gets its own; a cluster without one is an error, as its executors share no local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = context.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='cordon-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and drop its lineage, through the reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Shuffle files that no plan needs any more go now: Spark removes them once the driver has collected their owners
    as garbage, which a driver with room to spare does late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder, and read back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_ts(value) -> "F.Column":
    """An explicit "now": text or datetime to a naive timestamp column."""
    return F.lit(str(value)).cast("timestamp_ntz")


def micros(col) -> "F.Column":
    """Microseconds since the epoch of a naive UTC timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))

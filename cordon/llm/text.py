"""Shared pieces: words, splits and keys as columns; tables; rows through Arrow."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\x20\x09-\x0D]+"  # what stands between words
BATCH_BYTES = 1 << 22  # of rows that a task handles at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row: a lambda variable is bound
    once, while a column that the optimiser inlines into a lambda is not."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Their number, without building a second array: edges of white space give one empty part each."""
    def count(parts):
        n = F.size(parts)
        return (n - (parts[0] == "").cast("int") - ((n > 1) & (parts[n - 1] == "")).cast("int")).cast("long")

    return let(F.split(F.coalesce(text, F.lit("")), SPACE), count)


def part_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def row_key(doc_id: Column, text: Column) -> Column:
    """A key from what a row holds, the same whenever and wherever it is computed. Rows equal in both share it."""
    return F.xxhash64(doc_id, text)


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES):
    """``batch`` in runs of whole rows of about ``limit`` bytes, so that what is made of a run stays small."""
    step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def with_arrays(df: DataFrame, text: str, fields: list[T.StructField], compute: Callable[[pa.Array], list[pa.Array]], keep_text: bool = True) -> DataFrame:
    """``df`` with the columns of ``fields``, which ``compute`` makes from an Arrow batch of whole
    texts (one value a row each). A column of ``df`` with such a name is replaced."""
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new and (keep_text or f.name != text)]
    names = [f.name for f in keep] + [f.name for f in fields]

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                made = compute(batch.column(0))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=names)

    source = df.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{f.name}`") for f in keep])
    return source.mapInArrow(run, T.StructType([*keep, *fields]))

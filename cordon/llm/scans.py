"""Running totals and hashes in order within keys, where one key may hold any share of the rows."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.session import cut

JOINED = {"count": lambda a, b: a + b, "sum": lambda a, b: a + b, "bit_xor": lambda a, b: a ^ b}


def running(df: DataFrame, key: str, order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a running total per ``key`` in ``order`` for each name of ``totals``: (kind, column), kind one of
    ``JOINED``. Rows are dealt by range of key and order, so that a hot key spans as many partitions as it fills;
    each partition totals its own stretch, and what a key brings along from earlier partitions is added. The driver
    sees two rows a partition: its first and its last key's totals. Keys are not null."""
    dealt = cut(df.repartitionByRange(F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    made = {name: getattr(F, kind)(column) for name, (kind, column) in totals.items()}
    sums = dealt.groupBy("_part", key).agg(*[c.alias(n) for n, c in made.items()])
    row = F.struct(key, *totals)
    ends = sums.groupBy("_part").agg(F.min(row).alias("first"), F.max(row).alias("last")).collect()
    carried, brought, at = [], {}, None
    for part in sorted(ends, key=lambda r: r["_part"]):
        first, last = part["first"], part["last"]
        if first[0] == at:
            carried.append((part["_part"], at, *[brought[n] for n in totals]))
        if last[0] == at:  # the whole partition is one key's
            brought = {n: JOINED[totals[n][0]](brought[n], last[n]) for n in totals}
        else:
            at, brought = last[0], {n: last[n] for n in totals}
    key_type = next(f.dataType for f in df.schema.fields if f.name == key)
    schema = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField(key, key_type), *[T.StructField(f"_{n}", T.LongType()) for n in totals]])
    before = F.broadcast(df.sparkSession.createDataFrame(carried, schema))
    window = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({n: c.over(window) for n, c in made.items()}).join(before, ["_part", key], "left")
    plus = {n: F.col(n).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))) if totals[n][0] == "bit_xor" else F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in totals}
    return out.withColumns(plus).drop("_part", *[f"_{n}" for n in totals])


def joined_sha256(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """Per distinct ``keys``: lowercase SHA-256 of the decimal values of ``order``, ascending, comma-joined. A
    SHA-256 has to be fed in order, so a key's values pass through one task, but as a stream: none are gathered."""
    fields = [f for f in df.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    names = [*keys, out]

    def run(batches):
        at, state = None, None
        for batch in batches:
            found, made = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for *key, value in zip(*columns, strict=True):
                if key != at:
                    if state is not None:
                        found.append(at)
                        made.append(state.hexdigest())
                    at, state = key, hashlib.sha256(str(value).encode())
                else:
                    state.update(b",%d" % value)
            if found:
                yield table(found, made)
        if state is not None:
            yield table([at], [state.hexdigest()])

    def table(found, made):
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in zip(*found, strict=True)], pa.array(made, pa.string())], names=names)

    rows = df.select(*keys, order).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.StringType())]))

"""Runs of characters that texts have in common with a set of runs, found before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26  # of the screen, 8 MB; beyond some 2^26 runs it holds back less, and no result changes
CHARS = 1 << 20  # read at a time


def _cells(codes: np.ndarray, width: int) -> np.ndarray:
    """The cell of the screen of each run of ``width`` code points."""
    n = len(codes) - width + 1
    h = np.full(max(n, 0), width, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BITS - 1)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _screen(runs: DataFrame) -> np.ndarray:
    """One bit a cell; Spark sets them, and only the bits reach the driver, 4 KB at a time."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"cell": pa.array([int(_cells(_codes(run), len(run))[0]) + 1 for run in batch.column(0).to_pylist()], pa.int64())})

    bits = runs.mapInArrow(cells, "cell long").groupBy(F.expr("bitmap_bucket_number(cell)").alias("part"))
    held = np.zeros(BITS // 8, np.uint8)
    for row in bits.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits")).toLocalIterator():
        held[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return held


def runs_among(texts: DataFrame, text_id: str, text: str, runs: DataFrame, run: str, widths: list[int]) -> DataFrame:
    """``(text_id, run)``, each pair once a text: the runs of ``widths`` characters of each text that may be among
    ``runs``. None of those is missing; a few others can be there, so a join on the run has to follow."""
    shared = texts.sparkSession.sparkContext.broadcast(_screen(runs.select(run)))

    def of(ids: pa.Array, part: list[str]) -> pa.RecordBatch:
        joined, bit = "".join(part), shared.value
        codes, ends = _codes(joined), np.cumsum([len(t) for t in part])
        found = set()
        for width in widths:
            if len(codes) < width:
                continue
            cell = _cells(codes, width)
            at = np.flatnonzero((bit[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            owner = np.searchsorted(ends, at, side="right")
            inside = at + width <= ends[owner]
            found.update((o, joined[i : i + width]) for o, i in zip(owner[inside].tolist(), at[inside].tolist()))
        rows = sorted(found)
        return pa.record_batch({text_id: ids.take(pa.array([o for o, _ in rows], pa.int64())), run: pa.array([r for _, r in rows], pa.string())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, start, size = batch.column(1), 0, 0
            part: list[str] = []
            for i in range(len(body)):
                part.append(body[i].as_py())
                size += len(part[-1])
                if size >= CHARS or i + 1 == len(body):
                    yield of(batch.column(0).slice(start, len(part)), part)
                    part, start, size = [], i + 1, 0

    read = texts.select(text_id, text).where(F.col(text).isNotNull())
    kind = read.schema[text_id].dataType.simpleString()
    return read.mapInArrow(scan, f"`{text_id}` {kind}, `{run}` string")

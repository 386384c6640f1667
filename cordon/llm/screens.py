"""A count-min screen over 64-bit hashes: which of them surely occur once?"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CELLS = 1 << 28  # of each of the two rows, one bit each once counted: 64 MB in all


def cells_for(wanted: int) -> int:
    """A power of two of at least ``wanted`` cells, within bounds."""
    return min(MAX_CELLS, max(1 << 15, 1 << math.ceil(math.log2(wanted + 1))))


class Screen:
    """Two rows of cells; an estimate is the smaller of two cells, so it is one where either was hit once. Cells are
    counted by Spark, and only one bit of each (hit more than once) reaches the driver and the tasks: at most
    2 * ``MAX_CELLS`` bits. Fewer cells than hashes prove less and change no result."""

    def __init__(self, hashes: DataFrame, x: Column, y: Column, cells: int | None = None, least: int = 2):
        if cells is None:
            cells = cells_for(4 * hashes.count())
        hit = hashes.select(F.explode(F.array(F.pmod(x, F.lit(cells)), F.pmod(y, F.lit(cells)) + cells)).alias("cell"))
        busy = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select((F.col("cell") + 1).alias("cell"))
        bits = busy.groupBy(F.expr("bitmap_bucket_number(cell)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
        held = np.zeros((2 * cells + 7) // 8, np.uint8)
        for row in bits.toLocalIterator():
            at = (row["part"] - 1) * 4096
            part = np.frombuffer(row["bits"], np.uint8)[: len(held) - at]
            held[at : at + len(part)] = part
        self.cells, self.shared = cells, hashes.sparkSession.sparkContext.broadcast(held)

    def surely_fewer(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """True where a hash (both of its int64 forms) surely occurs fewer than ``least`` times."""
        bit = self.shared.value
        a, b = x % self.cells, y % self.cells + self.cells
        return (bit[a >> 3] >> (a & 7).astype(np.uint8)) & (bit[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 0

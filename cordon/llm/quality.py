"""Quality classifier: Naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.llm.hashing import bounds, ngrams, pieces, word_hashes
from cordon.llm.linear import fit_hinge, fit_link, logistic
from cordon.llm.text import part_of, with_arrays
from cordon.operators.sizes import fits

DIM = 1 << 16
FIT_ROWS = 8000  # bound on the labelled rows of the hinge-loss fit; class counts use all of them
LABEL_ROWS = 1_000_000  # labels up to this number are broadcast, more are joined by a shuffle

_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[48:58] = 48  # digits alike
_SEEN[[9, 10, 11, 12, 13]] = 32


def indicators(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: byte 3-grams, words and word pairs, hashed. A word that follows
    itself is a feature of its own, whichever word it is."""
    rows = len(off) - 1
    flags = np.zeros(rows * DIM, bool)
    if len(data):
        b = _SEEN[data].astype(np.uint32)
        doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
        if len(b) > 2:
            h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
            same = doc[:-2] == doc[2:]
            flags[(doc[:-2] * DIM + (h >> np.uint32(16)).astype(np.int64))[same]] = True
        start, end, at = bounds(data, off)
        w = word_hashes(data, start, end)
        flags[at * DIM + (w >> np.uint64(48)).astype(np.int64)] = True
        pair = ngrams(w, 2)
        if len(pair):
            pair = np.where(w[:-1] == w[1:], np.uint64(0), pair)
            same = at[:-1] == at[1:]
            flags[(at[:-1] * DIM + (pair >> np.uint64(48)).astype(np.int64))[same]] = True
    found = np.flatnonzero(flags)
    return found // DIM, found % DIM


@dataclass
class Model:
    weights: np.ndarray | None  # ratio times hinge weight of each feature, then the bias; None: no two classes
    link: tuple[float, float]
    ratio: np.ndarray | None = None

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        a, b = self.link
        if self.weights is None:
            return np.full(rows, float(logistic(np.array(b))))
        length = np.sqrt(np.bincount(row, self.ratio[feature] ** 2, rows))
        return logistic(a * (np.bincount(row, self.weights[feature], rows) / np.maximum(length, 1e-9) + self.weights[DIM]) + b)


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows with each feature, for label 1 and label 0, over all ``rows`` (text, quality). Each task adds up
    dense counts, so that at most DIM rows a task are shuffled, however long the input."""
    def count(batches):
        kept = np.zeros((2, DIM), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi, data, off in pieces(batch.column(0)):
                row, feature = indicators(data, off)
                for c in (0, 1):
                    kept[c] += np.bincount(feature[label[lo:hi][row] == c], minlength=DIM)
        some = np.flatnonzero(kept.any(0))
        for at in np.array_split(some, max(1, len(some) // 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(kept[1, at]), pa.array(kept[0, at])], names=["feature", "good", "bad"])

    found = rows.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(count, "feature int, good bigint, bad bigint")
    got = found.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    out = np.zeros((2, DIM))
    out[0, got["feature"].to_numpy()], out[1, got["feature"].to_numpy()] = got["good"].to_numpy(), got["bad"].to_numpy()
    return out[0], out[1]


def sparse(column: pa.Array) -> list[pa.Array]:
    out = []
    for _, _, data, off in pieces(column):
        row, feature = indicators(data, off)
        cuts = np.searchsorted(row, np.arange(1, len(off) - 1))
        out.extend(x.astype(np.int32) for x in np.split(feature, cuts))
    return [pa.array(out, pa.list_(pa.int32()))]


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, smooth: float = 1.0, blend: float = 0.25) -> Model:
    """From rows (doc_id, text, quality 0 or 1). Features are scaled by the log ratio of their smoothed class
    frequencies over all rows; the hinge loss is fitted on the first ``fit_rows`` by a hash of the id, and its
    weights are blended with their mean size. One row in five of those sets the logistic link only."""
    ids = rows.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = rows.join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    fields = [T.StructField("_at", T.ArrayType(T.IntegerType()))]
    got = with_arrays(texts, "text", fields, sparse, keep_text=False).toArrow().sort_by("doc_id")
    y = np.where(got["quality"].to_numpy() == 1, 1.0, -1.0) if got.num_rows else np.zeros(0)
    if len(set(y)) < 2:
        p = ((y > 0).sum() + 1) / (len(y) + 2)
        return Model(None, (1.0, float(np.log(p / (1 - p)))))
    good, bad = class_counts(rows)
    ratio = np.log((good + smooth) / (good + smooth).sum()) - np.log((bad + smooth) / (bad + smooth).sum())
    at = [np.asarray(x, np.int64) for x in got["_at"].to_numpy()]
    scaled = [(x, ratio[x] / max(float(np.sqrt((ratio[x] ** 2).sum())), 1e-9)) for x in at]
    held = np.arange(len(y)) % 5 == 4
    w = fit_hinge([r for r, h in zip(scaled, held, strict=True) if not h], y[~held], DIM)
    w[:DIM] = (1 - blend) * w[:DIM] + blend * np.abs(w[:DIM]).mean()
    weights = np.append(ratio * w[:DIM], w[DIM])
    margin = np.array([(weights[x].sum() / max(float(np.sqrt((ratio[x] ** 2).sum())), 1e-9)) + w[DIM] for x in at])
    return Model(weights, fit_link(margin[held], y[held]), ratio)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted from whole texts; null is as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        model, out = shared.value, []
        for _, _, data, off in pieces(column):
            row, feature = indicators(data, off)
            out.append(model.score(row, feature, len(off) - 1))
        return [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

    made = with_arrays(docs.drop("predicted"), "text", [T.StructField("score", T.DoubleType())], run, keep_text)
    return made.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, text, quality) of the documents that one clear label marks. Ids whose labels disagree are left out."""
    clear = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    clear = clear.where("quality = _most").drop("_most")
    side = F.broadcast(clear) if fits(labels, LABEL_ROWS) else clear
    return docs.select("doc_id", "text").join(side, "doc_id")


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.7, keep_text: bool = True) -> DataFrame:
    """Learn from labelled rows whose crc32(doc_id) mod 4 is not 2, score all.

    ``docs`` has doc_id and text; its other columns stay, and score, predicted and held_out replace columns
    of those names. Null texts score as empty ones; with labels of one class or none every score is the
    smoothed share of label 1; an empty table gives no rows; repeated rows score alike."""
    held = part_of(F.col("doc_id"), 4) == 2
    model = fit(labelled(docs.where(~held), labels), fit_rows)
    return score(docs, model, threshold, keep_text).withColumn("held_out", held)

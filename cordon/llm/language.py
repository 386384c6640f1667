"""Language ID: the family first, then one-versus-one machines between its languages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.llm.hashing import pieces
from cordon.llm.linear import fit_hinge, fit_link, logistic
from cordon.llm.text import part_of, with_arrays

#: Families of common languages; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["pl", "cs", "sk", "ru", "uk", "bg", "sr", "hr", "sl"],
    "uralic": ["hu", "fi", "et"],
    "baltic": ["lt", "lv"],
}
DIM = 1 << 14
TRAIN_ROWS = 6000  # bound on the labelled rows that a model is fitted on, over all languages
PIECE_ROWS = 192  # rows of DIM counts that a task holds at once
UNKNOWN = "und"

_LETTERS = np.full(256, 32, np.uint32)  # other ASCII becomes a blank
for _b in range(97, 123):
    _LETTERS[_b] = _LETTERS[_b - 32] = _b
_LETTERS[128:] = np.arange(128, 256)


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x DIM: square roots of hashed counts of 1-, 2- and 3-byte grams of letters, at length 1."""
    rows = len(off) - 1
    b = _LETTERS[data]
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
    if len(b):  # runs of blanks count as one
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
        b, doc = b[keep], doc[keep]
    total = np.zeros(rows * DIM)
    h = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        slot = ((h * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
        same = doc[: len(slot)] == doc[n - 1 :]
        total += np.bincount((doc[: len(slot)] * DIM + slot)[same], minlength=rows * DIM)
    x = np.sqrt(total, out=total).reshape(rows, DIM)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


class Model:
    """One machine per family against the rest, one per pair of languages in a family; no pairs between families."""

    def __init__(self, labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        names = np.array(labels, dtype=object)
        self.languages = sorted(set(labels))
        self.families = sorted({family_of(x) for x in self.languages})
        kin = np.array([family_of(x) for x in labels], dtype=object)
        self.weights, self.links, self.pairs = [], [], []
        if len(self.families) > 1:
            for f in self.families:
                self._add(rows, kin == f)
        for f in self.families:
            own = [x for x in self.languages if family_of(x) == f]
            for i, first in enumerate(own):
                for second in own[i + 1 :]:
                    at = np.flatnonzero((names == first) | (names == second))
                    self._add([rows[k] for k in at], names[at] == first)
                    self.pairs.append((f, first, second))
        self.matrix = np.stack(self.weights, 1) if self.weights else np.zeros((DIM + 1, 0))
        self.weights = []

    def _add(self, rows, positive):
        """Fitted on four fifths; the link comes from the rest, whose margins are not fitted."""
        y = np.where(positive, 1.0, -1.0)
        held = np.arange(len(rows)) % 5 == 4
        w = fit_hinge([r for r, h in zip(rows, held, strict=True) if not h], y[~held], DIM)
        margin = np.array([w[at] @ v + w[DIM] for (at, v), h in zip(rows, held, strict=True) if h])
        self.weights.append(w)
        self.links.append(fit_link(margin, y[held]) if len(margin) else (1.0, 0.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index into ``languages`` and score of each row. Votes within the family decide; ties go to the surer margins, then to the first name."""
        a, b = np.array(self.links or [(1.0, 0.0)]).T
        p = logistic(a * (x @ self.matrix[:DIM] + self.matrix[DIM]) + b) if self.matrix.shape[1] else np.zeros((len(x), 0))
        one = len(self.families) == 1
        share = np.ones((len(x), 1)) if one else p[:, : len(self.families)]
        kin, lead = share.argmax(1), share.max(1)
        first = 0 if one else len(self.families)
        best, score = np.zeros(len(x), np.int64), lead.copy()
        for k, f in enumerate(self.families):
            own = [i for i, name in enumerate(self.languages) if family_of(name) == f]
            at = np.flatnonzero(kin == k)
            votes, sure = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)))
            for j, (g, left, right) in enumerate(self.pairs):
                if g == f:
                    q = p[at, first + j]
                    for name, value in ((left, q), (right, 1 - q)):
                        c = own.index(self.languages.index(name))
                        votes[:, c] += value >= 0.5
                        sure[:, c] += value
            won = (votes + sure / (len(own) + 1)).argmax(1) if len(own) > 1 else np.zeros(len(at), np.int64)
            best[at] = np.array(own)[won]
            if len(own) > 1:
                score[at] *= sure[np.arange(len(at)), won] / (len(own) - 1)
        return best, score


def sparse(column: pa.Array) -> list[pa.Array]:
    at, value = [], []
    for _, _, data, off in pieces(column, rows=PIECE_ROWS):
        for row in counts(data, off):
            nonzero = np.flatnonzero(row)
            at.append(nonzero.astype(np.int32))
            value.append(row[nonzero].astype(np.float32))
    return [pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model from rows (doc_id, text, lang) with a language and a text. At most ``train_rows``
    rows are fitted on, an equal share for each language, the first by a hash of the id."""
    ids = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    langs = ids.groupBy("lang").count().collect()
    if not langs:
        return None
    share = max(train_rows // len(langs), 12)
    # rows whose hash is surely past the share go before the window, so that a hot language is no hot group
    bound = F.element_at(F.create_map(*[F.lit(x) for r in langs for x in (r["lang"], int(min(1.0, (share + 100) * 1.5 / r["count"]) * (1 << 32)))]), F.col("lang"))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < bound)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id")
    picked = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share).select("doc_id", "lang").distinct()
    texts = docs.join(F.broadcast(picked), ["doc_id", "lang"])  # at most max(train_rows, 12 a language) ids
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # an id that repeats counts once
    fields = [T.StructField("_at", T.ArrayType(T.IntegerType())), T.StructField("_value", T.ArrayType(T.FloatType()))]
    got = with_arrays(texts, "text", fields, sparse, keep_text=False).toArrow()
    got = got.sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    rows = [(np.asarray(a), np.asarray(v)) for a, v in zip(got["_at"].to_numpy(), got["_value"].to_numpy(), strict=True)]
    return Model(got["lang"].to_pylist(), rows)


def predict(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score from the column text. Without a text, without a letter
    in it, or without a model the prediction is ``und`` with score 0."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    kept = docs.drop("lang_pred", "score")
    if model is None:
        return (kept if keep_text else kept.drop("text")).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> list[pa.Array]:
        model, best, score = shared.value, [], []
        for _, _, data, off in pieces(column, rows=PIECE_ROWS):
            b, s = model.predict(counts(data, off))
            best.append(b)
            score.append(s)
        names = pa.array(model.languages, pa.string())
        at = np.concatenate(best) if best else np.zeros(0, np.int64)
        return [names.take(pa.array(at)), pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())]

    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = with_arrays(kept.withColumn("_has", has), "text", fields, run, keep_text)
    return out.withColumns({
        "lang_pred": F.when(F.col("_has"), F.col("lang_pred")).otherwise(UNKNOWN), "score": F.when(F.col("_has"), F.col("score")).otherwise(0.0),
    }).drop("_has")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, keep_text: bool = True) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 5 is not 0, predict all.

    ``docs`` has doc_id, text, lang; its other columns stay, and lang_pred, score and held_out
    replace columns of those names. Null or letterless texts are ``und``; an empty table gives no rows;
    repeated rows are predicted alike; a null id counts as empty text for the split."""
    held = part_of(F.col("doc_id"), 5) == 0
    model = fit(docs.select("doc_id", "text", "lang").where(~held), train_rows)
    return predict(docs, model, keep_text).withColumn("held_out", held)

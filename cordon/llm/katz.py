"""Language-model scores by a Katz backoff bigram model.

Counts come from whole training texts. Discounts are Good-Turing's for counts up to FEW; what they save in a history goes to the words
not seen after it, in proportion to their unigram probabilities, by a weight that makes each history add up to exactly 1.

Every training word has its own unigram and its own bigrams at every size. The VOCABULARY most frequent words (training or not) are only what tasks
hold in memory: a pair of two of them is a gram of small ids; a pair with any other word is keyed by the 64-bit hashes of both words, and takes what is
not in memory (count of the word, count and backoff of the history) from Spark tables by shuffle joins. A word outside the memory has at most one
VOCABULARY-th of all tokens, so no key of those joins is hot.

Tables in the shared folder: counts (word, n), far pairs with their counts, histories outside the memory. Grams (gram, row) are partitioned by gram by the
shuffle and read in order, where a gram's training rows are its count. Grams that very many rows hold are counted exactly in a pass of their own, before
any shuffle, so that no partition gets a hot gram.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordon.llm.hashing import LOWERED, bounds, ngrams, pieces, word_hashes
from cordon.llm.text import part_of
from cordon.session import cut, shared_table

VOCABULARY = 1 << 18  # words that tasks hold in memory; no result depends on it
COMMON = 1 << 18  # bigrams counted before the shuffle, at most: a bound on what is broadcast
COUNTERS = 1 << 21  # of a task that looks for common bigrams
FEW = 5  # counts up to this are discounted
_START, _END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def discounts(n: list[int]) -> list[float]:
    """Katz's factors of counts 1 to FEW from the numbers n[r] of types seen r times (n[0] unused). Where the estimates are no factors (too few
    types), the largest smaller range that gives some is used; else half a count is taken off each."""
    for few in range(FEW, 0, -1):
        if n[1] and all(n[r] for r in range(1, few + 1)):
            big = (few + 1) * n[few + 1] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - big) / (1 - big) if big < 1 else 0.0 for r in range(1, few + 1)]
            if all(0 < x < 1 for x in d):
                return d + [1.0] * (FEW - few)
    return [(r - 0.5) / r for r in range(1, FEW + 1)]


def sequence(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of start, words, end of each row in turn, the row of each, and where the starts are."""
    data = LOWERED[data]
    start, end, at = bounds(data, off)
    words = word_hashes(data, start, end)
    rows = len(off) - 1
    cuts = np.searchsorted(at, np.arange(rows + 1))
    out = np.empty(len(words) + 2 * rows, np.uint64)
    first = cuts[:-1] + 2 * np.arange(rows)
    out[np.arange(len(words)) + 2 * at + 1] = words
    out[first] = _START
    out[cuts[1:] + 2 * np.arange(rows) + 1] = _END
    return out, np.repeat(np.arange(rows), np.diff(cuts) + 2), first


def _merge(held: np.ndarray, seen: np.ndarray, keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([held, keys])
    order = np.argsort(both, kind="stable")  # two sorted runs: a merge
    both = both[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(len(both), 1), bool), both[1:] != both[:-1]]))
    return both[at], np.add.reduceat(np.concatenate([seen, count])[order], at) if len(at) else seen


def counted(docs: DataFrame) -> DataFrame:
    """(word, n, held, pair, times) of texts with a flag ``train``: exact word counts by task in training and other texts, and the task's most frequent pairs in both."""
    def run(batches):
        none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        words, held, seen = [(none, zero), (none, zero)], none, zero  # words of other texts, of training texts

        def rows(a, b, train, c, d):
            null = lambda x: pa.nulls(len(x), pa.int64())
            columns = [null(c), null(c), null(c), pa.array(c.view(np.int64)), pa.array(d)] if a is None else [pa.array(a.view(np.int64)), *map(pa.array, (b * train, b * (1 - train))), null(a), null(a)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", "held", "pair", "times"])

        for batch in batches:
            trains = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in pieces(batch.column(0), 1 << 22, 4096):
                tokens, doc, first = sequence(data, off)
                pair = ngrams(tokens, 2)
                keep = np.ones(len(tokens), bool)
                keep[first] = False
                train = trains[lo:hi][doc]
                for i, own in enumerate((keep & ~train, keep & train)):
                    words[i] = _merge(*words[i], *np.unique(tokens[own], return_counts=True))
                    if len(words[i][0]) > COUNTERS:
                        yield rows(*words[i], i, None, None)
                        words[i] = (none, zero)
                held, seen = _merge(held, seen, *np.unique(pair[keep[1:]], return_counts=True))
                if len(held) > COUNTERS:
                    keep = seen > 1 if np.count_nonzero(seen > 1) <= COUNTERS // 2 else seen >= np.partition(seen, -COUNTERS // 2)[-COUNTERS // 2]
                    held, seen = held[keep], seen[keep]
        for i in (0, 1):
            yield rows(*words[i], i, None, None)
        top = np.flatnonzero(seen > 1)
        if len(top) > COMMON:
            top = top[np.argsort(-seen[top], kind="stable")[:COMMON]]
        yield rows(None, None, None, held[top], seen[top])

    return docs.select("text", "train").mapInArrow(run, "word long, n long, held long, pair long, times long")


class Places:
    """Where a hash stands among sorted ones: a table of their first bits leads to the few that share them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(len(keys).bit_length() + 1, 1)
        first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.first = np.append(first, len(keys)).astype(np.int32)

    def find(self, hashes: np.ndarray, default: int) -> np.ndarray:
        """The place of each of ``hashes``, else ``default``."""
        out = np.full(len(hashes), default, np.int64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[1:][bucket]
        todo = np.flatnonzero(at < end)
        at, end, hashes = at[todo], end[todo], hashes[todo]
        while len(todo):
            hit = self.keys[at] == hashes
            out[todo[hit]] = at[hit]
            at = at + 1
            more = ~hit & (at < end)
            todo, at, end, hashes = todo[more], at[more], end[more], hashes[more]
        return out


@dataclass
class Model:
    """What every task needs; its arrays have at most VOCABULARY + 2 or COMMON entries."""

    total: int  # training tokens
    types: int  # distinct ones
    texts: int
    words: np.ndarray  # hashes of the vocabulary, sorted
    counts: np.ndarray  # in training, of the vocabulary, then 0, then of the start
    few: list[float]  # unigram discounts
    low: np.ndarray = field(default=None)  # log10 unigram probability of the vocabulary
    spare: float = 1.0  # probability of all unseen words
    shrink: float = 1.0  # of the others, to leave that
    table: DataFrame = field(default=None)  # (word, n) of every word; not sent to tasks
    pairs: np.ndarray = field(default=None)  # hashes of common pairs, sorted
    times: np.ndarray = field(default=None)  # their training counts

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("word_places", "pair_places", "log_counts")} | {"table": None}

    @cached_property
    def word_places(self) -> Places:
        return Places(self.words)

    @cached_property
    def pair_places(self) -> Places:
        return Places(self.pairs)

    @cached_property
    def log_counts(self) -> np.ndarray:
        return np.log10(self.counts + 1.0)

    @property
    def away(self) -> int:
        """The id of every word that is not held in memory."""
        return len(self.words)

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        out = self.word_places.find(tokens, self.away)
        out[tokens == _START] = self.away + 1
        return out

    def common(self, pair: np.ndarray) -> np.ndarray:
        """Index of each common pair, else -1."""
        return self.pair_places.find(pair, -1)


def _unigram(model: Model, few_mass: float) -> None:
    """Discounted unigram probabilities, and what they leave to unseen words (never nothing)."""
    model.spare = 1.0 - few_mass if model.total else 1.0
    if model.spare < 1e-12:  # no discounted word: one more token, unseen, is assumed
        model.shrink = model.total / (model.total + 1)
        model.spare = 1 - model.shrink
    c = model.counts[: model.away].astype(float)
    factor = np.ones(len(c))
    for r, d in enumerate(model.few, 1):
        factor[c == r] = d
    model.low = np.log10(np.where(c > 0, factor * c / max(model.total, 1) * model.shrink, model.spare))


def _low(model: Model, n: Column) -> Column:
    """The same for a column of training counts."""
    factor = F.lit(1.0)
    for r, d in enumerate(model.few, 1):
        factor = F.when(n == r, d).otherwise(factor)
    return F.log10(F.when(n > 0, factor * n / float(max(model.total, 1)) * model.shrink).otherwise(model.spare))


def fit_unigrams(docs: DataFrame, vocabulary: int = VOCABULARY, common: int = COMMON) -> Model:
    """Of texts with a flag ``train``."""
    found = shared_table(counted(docs).groupBy("word", "pair").agg(*[F.sum(c).alias(c) for c in ("n", "held", "times")]), "katz-counts")
    words = found.where("word is not null")
    few = [F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, FEW + 2)]
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") > 0).alias("types"), *few).first()
    end = np.array([_END]).view(np.int64)[0]
    first = F.when(F.col("word") == F.lit(int(end)), 0).otherwise(1)  # the end is always in the vocabulary
    top = words.select("word", "n", "held").orderBy(first, F.desc(F.col("n") + F.col("held")), "word").limit(vocabulary).toArrow()
    hashes, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(hashes)
    texts = int(n[hashes == _END].sum())
    counts = np.concatenate([n[order], [0, texts]]).astype(np.int64)
    n_of = [0, *[row[f"n{r}"] for r in range(1, FEW + 2)]]
    model = Model(row["total"], row["types"], texts, hashes[order], counts, discounts(n_of), table=words.where("n > 0").select("word", "n"))
    mass = sum(d * r * n_of[r] for r, d in enumerate(model.few, 1)) + (row["total"] - sum(r * n_of[r] for r in range(1, FEW + 1)))
    _unigram(model, mass / max(row["total"], 1))
    pairs = found.where("pair is not null").orderBy(F.desc("times"), "pair").limit(common).toArrow()["pair"].to_numpy().view(np.uint64)
    model.pairs, model.times = np.sort(pairs), np.zeros(len(pairs), np.int64)
    return model


def _pairs(model: Model, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the second word, history id, word id, index of the common pair or -1) of each token of a piece. A pair with a word outside
    the vocabulary is never taken as common: it is at most as frequent as that word."""
    keep = np.ones(len(tokens), bool)
    keep[first] = False
    at = np.flatnonzero(keep)
    ids = model.ids(tokens)
    history, word = ids[at - 1], ids[at]
    index = model.common(ngrams(tokens, 2)[at - 1])
    index[(history == model.away) | (word == model.away)] = -1
    return at, history, word, index


def fit_common(train: DataFrame, model: Model) -> Model:
    """Exact counts of the common pairs: dense counters in each task, added up by a shuffle of at most COMMON rows a task."""
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        n = np.zeros(len(model.pairs), np.int64)
        sides = np.full((2, len(model.pairs)), -1, np.int64)
        for batch in batches:
            for _, _, data, off in pieces(batch.column(0), rows=4096):
                tokens, _, first = sequence(data, off)
                _, history, word, index = _pairs(model, tokens, first)
                hit = index >= 0
                n += np.bincount(index[hit], minlength=len(n))
                sides[0, index[hit]], sides[1, index[hit]] = history[hit], word[hit]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(sides[0, some]), pa.array(sides[1, some])], names=["i", "n", "history", "word"])

    got = train.select("text").mapInArrow(run, "i long, n long, history long, word long").groupBy("i").agg(F.sum("n").alias("n"), F.max("history").alias("history"), F.max("word").alias("word")).toArrow()
    shared.destroy()
    model.times[got["i"].to_numpy()] = got["n"].to_numpy()
    model.sides = np.full((2, len(model.pairs)), -1, np.int64)
    model.sides[0, got["i"].to_numpy()], model.sides[1, got["i"].to_numpy()] = got["history"].to_numpy(), got["word"].to_numpy()
    return model


def grams(keyed: DataFrame, shared) -> DataFrame:
    """(gram, row): a row for each token whose pair is of the vocabulary and not common. Bit 0 of ``row`` tells training rows."""
    def run(batches):
        model = shared.value
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for lo, hi, data, off in pieces(batch.column(0), rows=4096):
                tokens, doc, first = sequence(data, off)
                at, history, word, index = _pairs(model, tokens, first)
                own = (index < 0) & (history != model.away) & (word != model.away)
                yield pa.RecordBatch.from_arrays([pa.array(((history << 20) | word)[own]), pa.array(keys[lo:hi][doc[at[own]]])], names=["gram", "row"])

    return keyed.select("text", "row").mapInArrow(run, "gram long, row long")


SUMS = ["n_tokens", "known", "base", *[f"m{r}" for r in range(1, FEW + 1)], "big", "past"]


def far(keyed: DataFrame, shared, sums: bool = False) -> DataFrame:
    """(h, w, hn, wn, row): a row for each token whose pair has a word outside the vocabulary; hashes of history and word, and the training count
    of the one that is in the vocabulary. With ``sums``, of the same pass over the texts: kind 1 for these rows, and two more kinds.
    kind 0: each row of ``keyed`` with its doc_id and what its tokens give without the shuffle, in a struct: n_tokens, known, base, m1.. (tokens whose
    common pair has that count), big, past (what is taken off).
    kind 2: row and id of the history (in h) of each token whose common pair has no training rows; its backoff is still to be added."""
    kind = keyed.schema["doc_id"].dataType if sums else None
    whole = {0, 1, *range(3, 3 + FEW)}
    fields = pa.struct([(n, pa.int64() if i in whole else pa.float64()) for i, n in enumerate(SUMS)])

    def run(batches):
        model = shared.value

        def rows(kind, doc_id, h, w, hn, wn, row, made):
            n = len(row)
            null = lambda x, t=pa.int64(): pa.nulls(n, t) if x is None else x
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), null(doc_id, ids), *map(null, (h, w, hn, wn)), row, null(made, fields)], names=["kind", "doc_id", "h", "w", "hn", "wn", "row", "sums"])

        for batch in batches:
            keys, parts = batch.column(1).to_numpy(), []
            ids = batch.column(2).type if sums else None
            for lo, hi, data, off in pieces(batch.column(0), rows=4096):
                tokens, doc, first = sequence(data, off)
                at, history, word, index = _pairs(model, tokens, first)
                d = doc[at]
                own = (history == model.away) | (word == model.away)
                place, sides = at[own], (history[own], word[own])
                hashes = [pa.array(tokens[x].view(np.int64)) for x in (place - 1, place)]
                counts = [pa.array(model.counts[x], mask=x == model.away) for x in sides]
                row = pa.array(keys[lo:hi][d[own]])
                yield rows(1, None, *hashes, *counts, row, None) if sums else pa.RecordBatch.from_arrays([*hashes, *counts, row], names=["h", "w", "hn", "wn", "row"])
                if not sums:
                    continue
                add = lambda where, value=None: np.bincount(d[where], value, hi - lo)
                common = np.flatnonzero(index >= 0)
                n = model.times[index[common]]
                past = np.where(n > 0, model.log_counts[history[common]], -model.low[np.minimum(word[common], model.away - 1)])
                seen, late, missed, near = common[n > 0], n > FEW, common[n == 0], np.flatnonzero(word != model.away)
                counted = np.bincount((FEW + 1) * d[seen] + np.minimum(n[n > 0], FEW + 1) - 1, minlength=(FEW + 1) * (hi - lo)).reshape(-1, FEW + 1)
                parts.append([add(slice(None)), add(near[model.counts[word[near]] > 0]), add(near, model.log_counts[word[near]]), *counted.T[:FEW],
                              add(common[late], np.log10(n[late].astype(float))), add(common, past)])
                if len(missed):
                    yield rows(2, None, pa.array(history[missed]), None, None, None, pa.array(keys[lo:hi][d[missed]]), None)
            if parts:
                made = [np.concatenate(x) for x in zip(*parts, strict=True)]
                arrays = [pa.array(x.astype(np.int64 if i in whole else np.float64)) for i, x in enumerate(made)]
                yield rows(0, batch.column(2), None, None, None, None, batch.column(1), pa.StructArray.from_arrays(arrays, fields=list(fields)))

    if not sums:
        return keyed.select("text", "row").mapInArrow(run, "h long, w long, hn long, wn long, row long")
    inner = ", ".join(f"{n}: {'bigint' if i in whole else 'double'}" for i, n in enumerate(SUMS))
    return keyed.select("text", "row", "doc_id").mapInArrow(run, f"kind int, doc_id {kind.simpleString()}, h long, w long, hn long, wn long, row long, sums struct<{inner}>")


def far_counts(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` of far() with every count: h, near (is the history in the vocabulary), hn, row, low, own (training count of a word outside
    the vocabulary, else null), c (training count of the pair), head (one row of each pair)."""
    def looked_up(df, key, n):
        return df.drop(n).join(model.table.select(F.col("word").alias(key), F.col("n").alias(n)), key, "left").withColumn(n, F.coalesce(n, F.lit(0)))

    pair = Window.partitionBy("h", "w")

    def whole(df, near, own):
        c, head = F.sum(F.col("row").bitwiseAND(F.lit(1))).over(pair), F.row_number().over(pair.orderBy("row")) == 1
        return df.select("h", F.lit(near).alias("near"), "hn", "row", _low(model, F.col("wn")).alias("low"), (F.col("wn") if own else F.lit(None).cast("long")).alias("own"), c.alias("c"), head.alias("head"))

    word, history, both = rows.where("hn is not null"), rows.where("wn is not null"), rows.where("hn is null and wn is null")
    return whole(looked_up(word, "w", "wn"), True, True).unionByName(whole(looked_up(history, "h", "hn"), False, False)).unionByName(whole(looked_up(looked_up(both, "w", "wn"), "h", "hn"), False, True))


def gathered(rows: DataFrame, shared) -> DataFrame:
    """One pass over the grams in order. A gram's training rows are its count, which all its rows then know. Three kinds of sums:
    kind 0 by row (m1.., big, past, low), kind 1 by history (t1..: types with that count; seen: unigram mass of its types),
    kind 2 by row and history (n: tokens not seen after it)."""
    few = [f"m{r}" for r in range(1, FEW + 2)]
    names = ["kind", "row", "history", "known", *few, "big", "past", "low"]

    def run(batches):
        model = shared.value
        types, mass = np.zeros((model.away + 2, FEW + 2), np.int64), np.zeros(model.away + 2)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def table(kind, row, history, whole, real):
            n = len(row)
            zero, none = np.zeros(n), np.zeros(n, np.int64)
            cols = [whole.get(c, none) for c in ("known", *few)] + [real.get(c, zero) for c in ("big", "past", "low")]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(row), pa.array(history), *map(pa.array, cols)], names=names)

        def flush(gram, row):
            new = np.ones(len(gram), bool)
            new[1:] = gram[1:] != gram[:-1]
            run_of = np.cumsum(new) - 1
            count = np.bincount(run_of, row & 1).astype(np.int64)
            c = count[run_of]
            history, word = gram >> 20, gram & ((1 << 20) - 1)
            heads = np.flatnonzero(new & (c > 0))
            capped = np.minimum(c[heads], FEW + 2) - 1
            good = capped <= FEW
            np.add.at(types, (history[heads][good], capped[good]), 1)
            np.add.at(mass, history[heads], 10.0 ** model.low[word[heads]])
            keys, d = np.unique(row, return_inverse=True)
            add = lambda where, value=None: np.bincount(d[where], value, len(keys)).astype(np.int64 if value is None else np.float64)
            seen, missed = c > 0, c == 0
            yield table(0, keys, np.full(len(keys), -1), {f"m{r}": add(seen & (c == r)) for r in range(1, FEW + 1)}, {
                "big": add(seen & (c > FEW), np.log10(c[seen & (c > FEW)].astype(float))),
                "past": add(seen, model.log_counts[history[seen]]), "low": add(missed, model.low[word[missed]])})
            if missed.any():
                both, n = np.unique(d[missed] * (model.away + 2) + history[missed], return_counts=True)
                yield table(2, keys[both // (model.away + 2)], both % (model.away + 2), {"known": n.astype(np.int64)}, {})

        size, limit = 0, 1 << 18
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= limit:
                gram, row = (np.concatenate(x) for x in zip(*waiting, strict=True))
                cut_at = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if cut_at:
                    yield from flush(gram[:cut_at], row[:cut_at])
                limit = 1 << 18 if cut_at else 2 * limit
                waiting, size = [(gram[cut_at:], row[cut_at:])], len(gram) - cut_at
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
        some = np.flatnonzero(mass > 0)
        yield table(1, np.zeros(len(some), np.int64), some, {f"m{r}": types[some, r - 1] for r in range(1, FEW + 2)}, {"low": mass[some]})

    whole = ", ".join(f"{c} long" for c in ("known", *few))
    schema = f"kind int, row long, history long, {whole}, big double, past double, low double"
    found = rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in ("known", *few, "big", "past", "low")]
    return found.groupBy("kind", "row", "history").agg(*sums)


def backoffs(model: Model, histories: DataFrame, other: DataFrame) -> tuple[np.ndarray, list[float]]:
    """log10 backoff weight of each history of the vocabulary, and the pair discounts. ``histories`` (by id) and the near rows of ``other`` (h, near,
    t1.., mass) have at most VOCABULARY + 2 rows each; of the others of ``other`` only their sums come here."""
    few, own = [f"m{r}" for r in range(1, FEW + 2)], [f"t{r}" for r in range(1, FEW + 2)]
    types, mass = np.zeros((model.away + 2, FEW + 1)), np.zeros(model.away + 2)
    more = other.where("near").toArrow()
    for got, at, names, low in ((a := histories.select("history", *few, "low").toArrow(), a["history"].to_numpy(), few, "low"), (more, model.ids(more["h"].to_numpy().view(np.uint64)), own, "mass")):
        for r, c in enumerate(names):
            types[at, r] += got[c].to_numpy()
        mass[at] += got[low].to_numpy()
    live = np.flatnonzero(model.times > 0)
    history, word, n = model.sides[0, live], model.sides[1, live], model.times[live]
    small = n <= FEW + 1
    np.add.at(types, (history[small], n[small] - 1), 1)
    np.add.at(mass, history, 10.0 ** model.low[word])
    rest = other.where("not near").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in own]).first()
    d = discounts([0, *(types.sum(0).astype(int) + np.array(rest, int)).tolist()])
    saved = sum((1 - f) * r * types[:, r - 1] for r, f in enumerate(d, 1))
    left = (saved + 1) / (model.counts + 1.0)  # one more token than seen is assumed after each history
    weight = np.where(model.counts > 0, left / np.maximum(1.0 - mass, 1e-12), 1.0)
    return np.log10(weight), d


def score(docs: DataFrame, vocabulary: int = VOCABULARY, common: int = COMMON) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Learns from the rows whose crc32(doc_id) mod 7 is not 2. Letters A-Z count as a-z; the end is a token. Null texts are empty: their one token
    is the end. Without training texts every token is unseen, with probability 1. Repeated rows count as often in training and score alike; a null id
    counts as empty text for the split; an empty table gives no rows."""
    held = part_of(F.col("doc_id"), 7) == 2
    key = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(-2)).bitwiseOR(F.when(held, 0).otherwise(1).cast("long"))
    keyed = docs.select("doc_id", "text", key.alias("row"))
    model = fit_common(docs.where(~held), fit_unigrams(docs.select("text", (~held).alias("train")), vocabulary, common))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    found = shared_table(gathered(grams(keyed, shared), shared), "katz-sums", "kind")
    apart = shared_table(far(keyed, shared, True), "katz-far")
    pairs = shared_table(far_counts(apart.where("kind = 1").select("h", "w", "hn", "wn", "row"), model), "katz-far-counts")
    types = [F.count_if(F.col("c") == r).alias(f"t{r}") for r in range(1, FEW + 2)]
    other = shared_table(pairs.where("head and c > 0").groupBy("h", "near").agg(*types, F.sum(F.pow(F.lit(10.0), "low")).alias("mass"), F.max("hn").alias("n")), "katz-far-histories")
    weight, d = backoffs(model, found.where("kind = 1"), other)
    hashes = np.concatenate([model.words, np.array([0, _START], np.uint64)]).view(np.int64)
    histories = docs.sparkSession.createDataFrame(pa.table({"history": np.arange(len(hashes)), "h": hashes, "weight": weight}))  # VOCABULARY + 2 rows
    own = apart.where("kind = 0").select("row", "doc_id", "sums.*")
    times = own.groupBy("row").agg(F.count(F.lit(1)).alias("_times"))
    rare = apart.where("kind = 2").select("row", F.col("h").alias("history"), F.lit(1).cast("long").alias("known"))
    unseen = found.where("kind = 2").select("row", "history", "known").unionByName(rare).join(F.broadcast(histories), "history").select("row", (F.col("known") * F.col("weight")).alias("backoff"))
    saved = sum(((1 - f) * r * F.col(f"t{r}") for r, f in enumerate(d, 1)), F.lit(1.0))
    weights = other.where("not near").select("h", F.log10(saved / (F.col("n") + 1) / F.greatest(1 - F.col("mass"), F.lit(1e-12))).alias("weight"))
    missed = pairs.where("c = 0").select("h", "near", "row", "low", "own", "hn", "c")
    held_in = F.broadcast(histories.where(F.col("history") != model.away).select("h", "weight"))
    away = pairs.where("c > 0").withColumn("weight", F.lit(0.0)).unionByName(missed.where("near").join(held_in, "h"), True).unionByName(missed.where("not near").join(weights, "h", "left"), True)
    few = [f"m{r}" for r in range(1, FEW + 1)]
    parts = ["known", *few, "base", "big", "past", "low", "backoff"]
    seen = F.col("c") > 0
    away = away.select("row", (F.coalesce("own", F.lit(0)) > 0).cast("long").alias("known"), *[(F.col("c") == r).cast("long").alias(f"m{r}") for r in range(1, FEW + 1)], F.coalesce(F.log10(F.col("own") + 1), F.lit(0.0)).alias("base"),
                       F.when(F.col("c") > FEW, F.log10("c")).alias("big"), F.when(seen, F.log10(F.col("hn") + 1)).alias("past"), F.when(~seen, F.col("low")).alias("low"), F.coalesce("weight", F.lit(0.0)).alias("backoff"))
    near = found.where("kind = 0").select("row", *few, "big", "past", "low")
    sums = near.unionByName(unseen, True).unionByName(away, True).groupBy("row").agg(*[F.sum(c).alias(f"_{c}") for c in parts]).join(times, "row")
    every = own.join(sums, "row", "left")
    more = lambda c: F.coalesce(F.col(f"_{c}") / F.col("_times"), F.lit(0.0))  # noqa: E731  equal rows share a key
    total = sum(((F.col(c) + more(c)) * float(np.log10(d[r - 1] * r)) for r, c in enumerate(few, 1)), F.lit(0.0))
    total = total + F.col("big") + more("big") - F.col("past") - more("past") + more("low") + more("backoff")
    base = F.col("base") + more("base") - F.col("n_tokens") * float(np.log10(model.total + model.types + 1))
    return every.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.round(more("known"))).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))

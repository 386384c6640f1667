"""Katz scores where most words are outside the words held in memory, against brute force."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cordon.llm import katz


def texts():
    r = random.Random(11)
    words = [f"w{i}" for i in range(90)]
    out = [(i, " ".join(words[min(89, int(r.paretovariate(0.7)))] for _ in range(r.choice([1, 12, 40])))) for i in range(120)]
    return [*out, (120, None), (121, "held only words"), (None, "w1 w2 w3"), (5, out[5][1])] + [(i, f"once{i} never{i} w{i % 9}") for i in range(200, 240)]


def expected():
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    unigrams, pairs = collections.Counter(), collections.Counter()
    for i, t in texts():
        if not held(i):
            w = [*(t or "").split(), None]
            unigrams.update(w)
            pairs.update(zip([0, *w[:-1]], w, strict=True))
    total = sum(unigrams.values())
    n1, n2 = collections.Counter(unigrams.values()), collections.Counter(pairs.values())
    d1, d2 = (katz.discounts([0, *[n[r] for r in range(1, 7)]]) for n in (n1, n2))
    low = {w: (d1[c - 1] if c <= 5 else 1) * c / total for w, c in unigrams.items()}
    past, saved, mass = unigrams | collections.Counter({0: unigrams[None]}), collections.Counter(), collections.Counter()
    for (h, w), c in pairs.items():
        saved[h] += (1 - d2[c - 1]) * c if c <= 5 else 0
        mass[h] += low[w]

    def probability(h, w):
        if c := pairs[(h, w)]:
            return (d2[c - 1] if c <= 5 else 1) * c / (past[h] + 1)
        return low.get(w, 1 - sum(low.values())) * ((saved[h] + 1) / (past[h] + 1) / (1 - mass[h]) if past[h] else 1)

    out = []
    for i, t in texts():
        w = [*(t or "").split(), None]
        base = sum(math.log10((unigrams[x] + 1) / (total + len(unigrams) + 1)) for x in w)
        out.append((-1 if i is None else i, len(w), sum(x in unigrams for x in w), base, sum(math.log10(probability(h, x)) for h, x in zip([0, *w[:-1]], w, strict=True))))
    return sorted(out)


@pytest.mark.parametrize(("vocabulary", "common"), [(1, 1), (12, 4), (12, 1000), (10_000, 1000)])
def test_every_word_keeps_its_bigrams(spark, vocabulary, common):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    got = katz.score(docs, vocabulary, common).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "n_known", "base_score", "score").collect()
    want = expected()
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got)), want, strict=True):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_no_key_stands_for_many_words(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    model = katz.fit_unigrams(docs.select("text", F.lit(True).alias("train")), 1, 1)
    shared = spark.sparkContext.broadcast(model)
    keyed = docs.select("text", F.lit(1).cast("long").alias("row"))
    pairs = collections.Counter()
    for _, t in texts():
        w = [*(t or "").split(), None]
        pairs.update(p for p in zip([0, *w[:-1]], w, strict=True) if p != (0, None))
    got = [r["count"] for r in katz.far(keyed, shared).groupBy("h", "w").count().collect()]
    assert sorted(got) == sorted(pairs.values())

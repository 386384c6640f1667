"""Tokens of the Jaccard join move once, and only those of several classes stay."""

import random

import numpy as np

from cordon.llm import jaccard


def test_met_tokens_equal_brute_force(spark):
    """Few tokens with many classes, many tokens with one, repeated rows, batches of four rows."""
    rnd = random.Random(5)
    rows = [(rnd.choice([rnd.randrange(-3, 3), rnd.randrange(-(1 << 62), 1 << 62)]), rnd.randrange(40), 0) for _ in range(900)]
    rows = [(t, c, (t + c) % 7) for t, c, _ in rows] * 2 + [(99, 1, 0), (99, 1, 0), (100, 2, 0)]
    of = {}
    for t, c, _ in rows:
        of.setdefault(t, set()).add(c)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for n in (len(rows), 1, 0):
            df = spark.createDataFrame(rows[:n], "token long, class long, at int").repartition(3)
            got = sorted(map(tuple, jaccard.met(df, 3).collect()))
            assert got == sorted({r for r in rows[:n] if n > 1 and len(of[r[0]]) > 1})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tokens_are_shuffled_once(spark):
    rnd = random.Random(6)
    texts = [(i, " ".join(str(rnd.randrange(10**9)) for _ in range(2000))) for i in range(300)]
    docs = spark.createDataFrame([*texts, (300, texts[0][1] + " end")], "doc_id long, text string")
    none = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    tokens = jaccard.prefixes(docs, none, jaccard.SIZE, jaccard.PERCENT).count()
    sent = lambda: sum(e.totalShuffleWrite() for e in _executors(spark))
    before = sent()
    rows = jaccard.join(docs).collect()
    used = sent() - before
    assert tokens > 100_000 and used < 25 * tokens, (used, tokens)
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(i, i % 300) for i in range(301)]


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return [found.apply(k) for k in range(found.size())]

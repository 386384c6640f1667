"""Lookups and shared passes of the Katz operator."""

import collections

import numpy as np
from pyspark.sql import functions as F

from cordon.llm import katz


def test_places_equal_a_binary_search():
    r = np.random.default_rng(5)
    near = np.uint64(7 << 60) + r.integers(0, 1 << 20, 300, dtype=np.uint64)  # all share their first bits
    for keys in (np.zeros(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(near), np.unique(np.concatenate([near, r.integers(0, 2**63, 999, dtype=np.uint64)]))):
        asked = np.concatenate([keys, keys + np.uint64(1), r.integers(0, 2**63, 500, dtype=np.uint64)])
        want = [{int(k): i for i, k in enumerate(keys)}.get(int(a), -1) for a in asked]
        assert katz.Places(keys).find(asked, -1).tolist() == want


def test_one_pass_gives_far_pairs_and_sums(spark):
    rows = [(i, f"a b w{i} a b never{i}", i % 7) for i in range(60)] + [(60, None, 1), (61, " ", 1), (3, "a b w3 a b never3", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    model = katz.fit_common(docs.where("part > 1"), katz.fit_unigrams(docs.select("text", (F.col("part") > 1).alias("train")), 4, 2))
    shared = spark.sparkContext.broadcast(model)
    keyed = docs.select("text", "doc_id", F.col("doc_id").alias("row"))
    names = ["h", "w", "hn", "wn", "row"]
    found = katz.far(keyed, shared, True).cache()
    assert collections.Counter(found.where("kind = 1").select(names).collect()) == collections.Counter(katz.far(keyed, shared).select(names).collect())
    sums = {r["doc_id"]: r["sums"] for r in found.where("kind = 0").collect()}
    assert found.where("kind = 0").count() == len(rows) and sums[5]["n_tokens"] == 7 and sums[60]["n_tokens"] == sums[61]["n_tokens"] == 1


def test_runs_merge_like_one_count():
    r = np.random.default_rng(6)
    parts = [r.integers(0, 50, n).astype(np.uint64) for n in (0, 30, 400)]
    held, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for p in parts:
        held, seen = katz._merge(held, seen, *np.unique(p, return_counts=True))
    words, n = np.unique(np.concatenate(parts), return_counts=True)
    assert held.tolist() == words.tolist() and seen.tolist() == n.tolist()

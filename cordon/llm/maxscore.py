"""Exact top-k inner products by MaxScore over sharded postings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384  # vectors of a shard, about
BLOCK_ROWS = 1024  # queries of a block, about
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """Distinct (vec_id, v): each component x as floor(scale * x), x as double. Vectors null, empty, or holding null or
    non-finite components are left out."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long"))
    bad = F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad).select("vec_id", x.alias("v")).distinct()


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors of one shard for each query, ties to smaller ids, by MaxScore.

    A term is a dimension; its postings are that dimension's values, and its contribution to a query is counted above the
    least it can be in the shard, so that none is negative. Terms are ordered by bound. The essential ones, which are traversed
    for all vectors, are those without which no vector could pass the k-th best score known so far; vectors still competitive
    with the bounds of the rest added are probed in the remaining terms, dropping out as soon as they can't pass."""
    by_id = np.argsort(ids, kind="stable")
    ids, postings = ids[by_id], np.ascontiguousarray(vectors[by_id].T).astype(np.int64)
    high, low = postings.max(1), postings.min(1)
    out = []
    for qid, q in zip(query_ids, queries.astype(np.int64), strict=True):
        keep = min(k + int(np.count_nonzero(ids == qid)), len(ids))  # the query's own rows go at the end
        top, floor = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
        bound, base = top - floor, int(floor.sum())
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # most that the terms from here on add
        first = q @ postings[:, : 8 * keep]
        known = np.partition(first, -keep)[-keep] - base if len(first) >= keep else -1
        alive, partial, done = None, np.zeros(len(ids), np.int64), 0
        while done < len(order):
            need = rest[done] if done else None
            if need is not None and (alive is not None or need <= known):  # the terms left are not essential: only probe
                live = partial if alive is None else partial[alive]
                ok = live + need >= known
                alive = np.flatnonzero(ok) if alive is None else alive[ok]
                if len(alive) <= 4 * keep:
                    break
            for d in order[done : done + 4]:
                if alive is None:
                    partial += q[d] * postings[d] - floor[d]
                else:
                    partial[alive] += q[d] * postings[d, alive] - floor[d]
            done += 4
            if len(ids) > 4 * keep:  # what is sure of the best so far raises the bar
                live = partial if alive is None else partial[alive]
                if len(live) >= keep:
                    known = max(known, int(np.partition(live, -keep)[-keep]))
        at = np.arange(len(ids)) if alive is None else alive
        score = q @ postings[:, at]
        best = np.lexsort((ids[at], -score))
        best = best[ids[at][best] != qid][:k]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def _groups(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(left) or not len(right):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    return search_shard(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query among all ``vectors``; both are (vec_id, v).

    Vectors are dealt into shards and queries into blocks by hash; each shard meets each block once, in a task of its own, and gives its k best; these
    merge by rank, cut at k on each side of the shuffle. Rows of the query's own id are no candidates. Only vectors of the query's length are
    compared. Equal rows count once; two different vectors with one id are two candidates; empty tables give no rows."""
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    every_block, every_shard = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    deal = lambda salt, parts: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(parts)).cast("int")
    left = vectors.withColumns({"_shard": deal(1, shards), "_dim": F.size("v")}).withColumn("_block", every_block)
    right = queries.withColumns({"_block": deal(2, blocks), "_dim": F.size("v")}).withColumn("_shard", every_shard)
    keys = ["_dim", "_shard", "_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _groups(a, b, k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""The prefix trie of conversations, as node rows.

A prefix is told by a 128-bit digest: the exclusive or, over its turns, of two hashes of depth and turn, so that
prefix digests are running totals (``scans.running``) and no conversation need be in one task. A count-min sketch of
all digests screens them: an estimate of one proves that a prefix belongs to a single conversation, and everything
below it is then a tail, whose rows are emitted where they stand. Only the rest is grouped exactly.

Sums over subtrees take no rounds by depth: each node is owned by its smallest member, so what a subtree holds is
what its members own at that depth or deeper, which is a running total from the end of each conversation, summed by
digest. Hot nodes (the root, a common first turn) are only ever aggregated, or broadcast: fewer than ``HOT`` nodes
can hold more than one in ``HOT`` of all rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.llm.scans import joined_sha256, running
from cordon.llm.screens import Screen
from cordon.session import cut

EVERY, MODULO = 5, 9  # conversation c starts like c - c % EVERY for crc32(c) % MODULO turns
HOT = 1000
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes
ROW = ["conv_id", "depth", "length", "n_bytes", "px", "py", "qx", "qy"]


def items(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, item, n_bytes): turns in order, numbered from 1; item is 16 bytes of a SHA-256 of role and
    text. By turn (null first), equal turns by role, then item. Texts go no further than this."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("_role"), F.unhex(F.substring(whole, 1, 32)).alias("item"), F.octet_length(text).cast("long").alias("n_bytes"))
    placed = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("_role"), F.col("item")], {"place": ("count", "n_bytes")})
    return cut(placed.select("conv_id", "place", "item", "n_bytes"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, length, item, n_bytes) of every rebuilt conversation, from ``items``; depth 0 is its root."""
    c = F.col("conv_id")
    own = rows.groupBy("conv_id").agg(F.max("place").alias("n"))
    own = own.withColumn("base", c - c % EVERY).withColumn("h", F.when(c == F.col("base"), 0).otherwise(F.crc32(c.cast("string")) % MODULO))
    bases = own.where(c == F.col("base")).select("base", F.col("n").alias("n_base"))
    plan = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = cut(plan.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    heads = rows.where((c % EVERY == 0) & (F.col("place") < MODULO)).select(c.alias("base"), F.col("place").alias("depth"), "item", "n_bytes")
    borrowed = plan.where("taken > 0").join(heads, "base").where("depth <= taken").select("conv_id", "depth", "length", "item", "n_bytes")
    kept = rows.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "length", "item", "n_bytes")
    roots = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("n_bytes"))
    return roots.unionByName(borrowed).unionByName(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """``ROW`` of every prefix: its digest (px, py) and that of the prefix before it (qx, qy; null at the root)."""
    x = F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64("depth", "item"))
    y = F.when(F.col("depth") == 0, 0).otherwise(F.xxhash64("item", "depth", F.lit(1)))
    rows = running(rows.withColumns({"_x": x, "_y": y}).drop("item"), "conv_id", [F.col("depth")], {"px": ("bit_xor", "_x"), "py": ("bit_xor", "_y")})
    before = {q: F.when(F.col("depth") > 0, F.col(p).bitwiseXOR(F.col(h))) for q, p, h in (("qx", "px", "_x"), ("qy", "py", "_y"))}
    return cut(rows.withColumns(before).select(*ROW))


def proofs(screen: Screen):
    """A column function of a digest: does the sketch prove that it occurs once?"""

    @F.pandas_udf("boolean")
    def proven(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(screen.surely_fewer(x.to_numpy(), y.to_numpy()))

    return lambda x, y: F.col(x).isNotNull() & proven(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))


def with_parent(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with parent_conv_id. A parent that is no grouped node is a proven tail of the row's own conversation.
    Nodes of many members, fewer than ``HOT``, are broadcast; their children don't meet in a shuffle."""
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    named = nodes.select(F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_convs") * HOT > total).alias("_hot"))
    hot, cold = F.broadcast(named.where("_hot").drop("_hot")), named.where(~F.col("_hot")).drop("_hot")
    near = rows.join(hot, ["qx", "qy"])
    far = rows.join(hot, ["qx", "qy"], "left_anti").join(cold, ["qx", "qy"], "left")
    out = near.unionByName(far, allowMissingColumns=True)
    return out.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")))


def alone(rows: DataFrame, parent: Column) -> DataFrame:
    """Node rows of prefixes that belong to one conversation."""
    end = F.col("depth") == F.col("length")
    return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
                       F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"))


def trie(conversations: DataFrame, cells: int | None = None) -> DataFrame:
    """One row per node of the rebuilt conversations' prefix trie: conv_id (its smallest member), depth, parent_conv_id
    (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first; equal turns are ordered by role, then by a hash of role
    and text; repeated rows are turns of their own. Rows without a conv_id belong to no conversation and take no
    part. An empty table has no nodes. Columns other than conv_id, turn, role and text are ignored."""
    paths = prefixes(rebuilt(items(conversations)))
    proven = proofs(Screen(paths, F.col("px"), F.col("py"), cells))
    tested = paths.withColumns({"_one": proven("px", "py"), "_tail": proven("qx", "qy")})
    tails = alone(tested.where("_tail"), F.col("conv_id"))
    rest = cut(tested.where("NOT _tail").drop("_tail"))
    tops, shared = rest.where("_one").drop("_one"), rest.where("NOT _one").drop("_one")

    groups = shared.groupBy("px", "py").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "n_bytes", "qx", "qy")])
    groups = cut(groups)
    children = groups.select("qx", "qy").unionByName(tops.select("qx", "qy")).where("qx IS NOT NULL").groupBy(F.col("qx").alias("px"), F.col("qy").alias("py")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(groups.join(children, ["px", "py"], "left").fillna(0, ["n_children"]))

    owned = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("_saved"), (F.col("n_children") == 0).cast("long").alias("_leaf"))
    marked = shared.join(owned, ["conv_id", "depth"], "left").select("conv_id", "depth", "px", "py", F.coalesce("_saved", F.lit(0)).alias("_saved"), F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    ends = [r.where("depth = length") for r in (tops, tested.where("_tail"))]
    ends = [e.select("conv_id", "depth", F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), F.lit(0).cast("long").alias("_saved"), F.lit(1).cast("long").alias("_leaf")) for e in ends]
    below = running(marked.unionByName(ends[0]).unionByName(ends[1]), "conv_id", [F.col("depth").desc()], {"saved_tokens": ("sum", "_saved"), "n_leaves": ("sum", "_leaf")})
    sums = below.where("px IS NOT NULL").groupBy("px", "py").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    hashes = joined_sha256(shared.where("depth = length").select("px", "py", "conv_id"), ["px", "py"], "conv_id", "ends_sha256")

    full = nodes.join(sums, ["px", "py"], "left").join(hashes, ["px", "py"], "left").fillna({"ends_sha256": NOTHING})
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    grouped = with_parent(full, nodes).select(*names)
    single = with_parent(tops, nodes)
    return grouped.unionByName(alone(single, F.col("parent_conv_id"))).unionByName(tails)

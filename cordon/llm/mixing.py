"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cordon.llm.text import n_words
from cordon.operators.sizes import fits
from cordon.session import cut

WEIGHTS = (3, 1, 2)  # of sources in order, repeating
EPOCHS = 2  # most repetitions of a source
SHARE = (3, 2)  # the mix holds 3/2 of all words
SOURCE_ROWS = 100_000  # sources up to this number are broadcast, more are joined by a shuffle
DIGITS = 3  # hex digits of the seeded order that make a bucket: 4096 of them a source


def numbered(sources: DataFrame) -> DataFrame:
    """Sources in code point order, null last, numbered from 0 as ``_rank``. Dealt out by range, counted a
    partition, then numbered within it: no task sees all sources, the driver one count a partition."""
    null_last = F.col("source").isNull()
    dealt = cut(sources.repartitionByRange(null_last, "source").withColumn("_part", F.spark_partition_id()))
    first, before = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((part, first))
        first += n
    starts = dealt.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _start long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(null_last, "source")) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def fill(sources: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, share: tuple = SHARE) -> DataFrame:
    """``sources`` (source, source_size) with target. All start free with a part of share[0]/share[1] of all
    words by weight; each round stops those above ``epochs`` times their size there, and reshares the rest,
    until none is above. All sums are of whole numbers, so that every order of adding gives the same target."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    state = cut(numbered(sources).select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("full")))
    sums = "sum(source_size) as total", "sum(case when full then source_size end) as held", "sum(case when not full then weight end) as w", "count_if(full) as n"
    while True:
        row = state.selectExpr(*sums).first()
        total, held, free = int(row["total"] or 0), int(row["held"] or 0), int(row["w"] or 0)
        left = share[0] * total - share[1] * epochs * held  # over share[1]
        over = ~F.col("full") & (F.col("weight") * F.lit(left) > F.col("source_size") * F.lit(share[1] * epochs * max(free, 1)))
        more = cut(state.withColumn("full", F.col("full") | over))
        if more.where("full").count() == row["n"]:
            break
        state = more
    part = F.col("weight") * F.lit(left) / F.lit(share[1] * max(free, 1))
    return state.select("source", "source_size", F.when(F.col("full"), epochs * F.col("source_size")).otherwise(part).cast("double").alias("target"))


def prepared(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``docs`` with its size in words, its place in a seeded order, and that order's first digits."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    return docs.withColumns({"_mix_size": n_words(F.col("text")), "_mix_order": order, "_mix_bucket": F.substring(order, 1, DIGITS), "_mix_key": F.xxhash64("doc_id", "text")})


def plan(rows: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, share: tuple = SHARE) -> DataFrame:
    """Per source: target, whole repetitions, the words still needed, and the bucket of the seeded order in
    which they are reached, with the words before it."""
    targets = fill(rows.groupBy("source").agg(F.sum("_mix_size").alias("source_size")), weights, epochs, share)
    size, target = F.col("source_size"), F.col("target")
    targets = targets.withColumn("_whole", F.when(size > 0, F.floor(target / size)).otherwise(0)).withColumn("_need", F.round(target - F.col("_whole") * size).cast("long"))
    buckets = rows.groupBy("source", "_mix_bucket").agg(F.sum("_mix_size").alias("_words"))
    upto = Window.partitionBy("source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = buckets.withColumn("_upto", F.sum("_words").over(upto)).withColumnRenamed("source", "_s")  # at most 16 ** DIGITS rows a source
    crossing = sums.join(targets.select("source", "_need"), F.col("_s").eqNullSafe(F.col("source"))).where(F.col("_upto") >= F.col("_need"))
    crossing = crossing.groupBy("_s").agg(F.min(F.struct("_mix_bucket", (F.col("_upto") - F.col("_words")).alias("_before"))).alias("_at"))
    return cut(targets.join(crossing, F.col("_s").eqNullSafe(F.col("source")), "left").select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_total"), F.col("target").alias("_mix_target"), F.col("_whole").alias("_mix_whole"),
        F.col("_need").alias("_mix_need"), F.col("_at._mix_bucket").alias("_mix_edge"), F.coalesce("_at._before", F.lit(0)).alias("_mix_before")))


def decided(rows: DataFrame, by_source: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``rows`` with _mix_times. A row before its source's edge bucket is taken once more than the whole
    repetitions, one after it is not; only the edge buckets' rows are shuffled and ordered."""
    side = F.broadcast(by_source) if fits(by_source, SOURCE_ROWS) else by_source
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("_mix_source")))
    edge, size = F.col("_mix_bucket").eqNullSafe(F.col("_mix_edge")), F.col("_mix_size")
    sure = joined.where(~edge).withColumn("_mix_more", F.col("_mix_edge").isNull() | (F.col("_mix_bucket") < F.col("_mix_edge")))
    running = Window.partitionBy("_mix_source").orderBy("_mix_order", "doc_id", "_mix_size", "_mix_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.col("_mix_before") + F.sum("_mix_size").over(running) - F.col("_mix_need")
    near = joined.where(edge).withColumn("_mix_more", (2 * over <= size) & (size > 0))
    once = F.col("_mix_more") & (F.col("_mix_whole") < epochs)
    return sure.unionByName(near).withColumn("_mix_times", (F.col("_mix_whole") + once.cast("int")).cast("int"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, share: tuple = SHARE, seed: str = "mix") -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, repeats, taken.

    Each row is taken target / source_size times, rounded down; the remainder takes rows once more in a
    seeded order until its words are reached (the row that crosses it only if that is nearer). The order is cut
    into buckets by its first digits: sums of buckets find the one where each source crosses, and only
    the rows of that bucket are ordered. Null texts have size 0, a null source is a source, repeated rows
    count each, an empty table gives no rows; reruns agree."""
    rows = cut(prepared(docs.select("doc_id", "text", "source"), seed).drop("text"))
    out = decided(rows, plan(rows, weights, epochs, share), epochs)
    return out.select("doc_id", "source", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"), F.col("_mix_target").alias("target"),
                      F.col("_mix_times").alias("repeats"), (F.col("_mix_size") * F.col("_mix_times")).cast("long").alias("taken"))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, epochs: int = EPOCHS, share: tuple = SHARE, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; same columns. Texts are not shuffled, but for the edge buckets'."""
    narrow = cut(prepared(docs.select("doc_id", "text", "source"), seed).drop("text"))
    rows = decided(prepared(docs, seed), plan(narrow, weights, epochs, share), epochs)
    copies = F.explode(F.expr("case when _mix_times > 0 then sequence(1, _mix_times) else array() end"))
    return rows.withColumn("_mix_copy", copies).select(*[F.col(f"`{c}`") for c in docs.columns])

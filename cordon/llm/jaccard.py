"""N-gram Jaccard join by prefixes under several global orders.

Two sets with enough in common must share a token within the first few of each, whatever order all tokens are in.
A first order gives the candidates, through a shuffle by token; they stay only if their prefixes also share enough under further, independent
orders; what is left is compared in full. In every order the tokens that very many texts hold come last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.components import components
from cordon.llm.hashing import LOWERED, bounds, mix, ngrams, pieces, word_hashes
from cordon.operators.sizes import fits
from cordon.session import cut, tidy

SIZE = 5  # words of a shingle
PERCENT = 80  # least similarity
ORDERS = 3  # the first is joined on, the others filter
COMMON = 1 << 17  # tokens that are put last at most: a bound on what is broadcast, not on what is compared
COMMON_FROM = 3  # times that a token is seen in a task's rows before the task reports it
TOGETHER = 32  # partitions that one counting task reads at most, where there are more than cores
KEPT_TOKENS = 1 << 20  # counters of a task
SORTED = 500_000  # tokens of a task, about
TEXT_IDS = 500_000  # ids of texts to compare that are broadcast; more are joined by a shuffle


def shingle_sets(column: pa.Array, size: int = SIZE):
    """The sorted distinct shingle hashes of each text; letters A-Z as a-z. Fewer words than ``size`` make one
    shingle of their own, none make an empty set."""
    for _, _, data, off in pieces(column, rows=4096):
        data = LOWERED[data]
        start, end, at = bounds(data, off)
        words = word_hashes(data, start, end)
        grams = ngrams(words, size)
        cuts = np.searchsorted(at, np.arange(len(off)))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo >= size:
                yield np.unique(grams[lo : hi - size + 1])
            elif hi > lo:
                yield mix(ngrams(words[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield words[:0]


def prefix_length(n, percent: int = PERCENT):
    """Tokens from the start of an order among which a set of ``n`` must share one with any set that it links with."""
    return n - (n * percent + 99) // 100 + 1


def ordered(tokens: np.ndarray, order: int, common: np.ndarray) -> np.ndarray:
    """``tokens`` in a global order: rare ones by a hash of their own for each order, then the common ones."""
    rank = mix(tokens + np.uint64((order + 1) * 0xA24BAED4963EE407 % (1 << 64))) >> np.uint64(1)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        rank = rank | ((common[at] == tokens).astype(np.uint64) << np.uint64(63))
    return tokens[np.argsort(rank, kind="stable")]


def class_id(tokens: np.ndarray) -> int:
    """One number for a set, whatever order its tokens came in."""
    total = mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def enough(shared: int, left: int, n: int, m: int, percent: int = PERCENT) -> bool:
    """Can sets of n and m tokens link that share ``shared`` in their prefixes and have ``left`` tokens after them?"""
    return (100 + percent) * (shared + left) >= percent * (n + m)


def linked(x: np.ndarray, y: np.ndarray, common: np.ndarray, percent: int = PERCENT, orders: int = ORDERS) -> bool:
    """The filters of the orders after the first, then the exact test on whole sets."""
    n, m = len(x), len(y)
    if min(n, m) * 100 < max(n, m) * percent or not n:
        return False
    p, q = prefix_length(n, percent), prefix_length(m, percent)
    for order in range(1, orders):
        shared = len(np.intersect1d(ordered(x, order, common)[:p], ordered(y, order, common)[:q], assume_unique=True))
        if not shared or not enough(shared, max(n - p, m - q), n, m, percent):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (n + m - both)


def classes(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """One pass over whole texts: (doc_id, n_shingles, class) of each row, and the sorted tokens that many texts hold, from counts
    that each task keeps (the least seen are dropped when the counters are full) and that add up over the tasks."""
    def run(batches):
        held, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            ids = [class_id(s) if len(s) else None for s in sets]
            n = np.array([len(s) for s in sets], np.int64)
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ids, pa.int64()), none, none], names=names)
            if sets:  # equal sets of a batch count once: copies make no token common
                first = list({c: s for c, s in zip(ids, sets, strict=True) if c is not None}.values())
                for k in range(0, len(first), 500):
                    tokens, count = np.unique(np.concatenate(first[k : k + 500]), return_counts=True)
                    merged, back = np.unique(np.concatenate([held, tokens]), return_inverse=True)
                    seen = np.bincount(back, np.concatenate([seen, count])).astype(np.int64)
                    held = merged
                    if len(held) > KEPT_TOKENS:
                        keep = seen > 1 if np.count_nonzero(seen > 1) <= KEPT_TOKENS else seen >= np.partition(seen, -KEPT_TOKENS)[-KEPT_TOKENS]
                        held, seen = held[keep], seen[keep]
        top = np.flatnonzero(seen >= COMMON_FROM)
        if len(top) > COMMON:
            top = top[np.argsort(-seen[top], kind="stable")[:COMMON]]
        none = pa.nulls(len(top), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(top), id_type), none, none, pa.array(held[top].view(np.int64)), pa.array(seen[top])], names=names)

    names = ["doc_id", "n_shingles", "class", "token", "seen"]
    kind = docs.schema["doc_id"].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    source = docs.select("doc_id", "text")
    parts = source.rdd.getNumPartitions()  # small partitions are read together: what is common shows in a task's rows
    source = source.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, parts // TOGETHER))
    rows = cut(source.mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles long, class long, token long, seen long"))
    top = rows.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(COMMON)
    common = np.sort(top.toArrow()["token"].to_numpy().view(np.uint64))
    return rows.where("token is null").select("doc_id", "n_shingles", "class"), common


def prefixes(docs: DataFrame, common, size: int, percent: int) -> DataFrame:
    """(token, class, at) of each set's prefix under the first order, ``at`` from 0. A task gives equal sets once."""
    def run(batches):
        done: set[int] = set()
        for batch in batches:
            tokens, owners, at = [], [], []
            for s in shingle_sets(batch.column(0), size):
                if len(s) > 1 and (c := class_id(s)) not in done:  # a set of one token links only with equal sets
                    done.add(c)
                    tokens.append(ordered(s, 0, common.value)[: prefix_length(len(s), percent)])
                    owners.append(np.full(len(tokens[-1]), c, np.int64))
                    at.append(np.arange(len(tokens[-1]), dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(at))], names=["token", "class", "at"])

    return docs.select("text").mapInArrow(run, "token long, class long, at int")


def met(tokens: DataFrame, tasks: int) -> DataFrame:
    """The rows (token, class, at) whose token several classes hold, each once. One shuffle by token, into so many ``tasks`` that
    none need sort on disk; a task passes over its sorted rows and holds no token's group, however many classes are in it."""
    names = ["token", "class", "at"]

    def run(batches):
        last, wanted = None, False  # the last row so far, and whether its token has been met in another class
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(3)]
            if last is not None:
                cols = [np.concatenate([one, col]) for one, col in zip(last, cols, strict=True)]
            if not len(cols[0]):
                continue
            first = np.ones(len(cols[0]), bool)
            first[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[first] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            keep = np.append(wanted, same)
            keep[:-1] |= same
            last, wanted = [c[-1:] for c in cols], bool(keep[-1])
            if keep[:-1].any():
                yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in cols], names=names)
        if wanted:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=names)

    return tokens.repartition(tasks, "token").sortWithinPartitions("token", "class").mapInArrow(run, "token long, class long, at int")


def compared(pairs: DataFrame, docs: DataFrame, members: DataFrame, common, size: int, percent: int, orders: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes that link. Only texts of classes in pairs are shuffled, one text a class: first to the pairs by b,
    then to those by a, where the join may split a class that is in very many pairs."""
    needed = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    needed = cut(members.join(needed, "class").select("doc_id", "class"))
    side = F.broadcast(needed) if fits(needed, TEXT_IDS) else needed

    def own(batches):  # an id that repeats may have other texts too
        for batch in batches:
            want = batch.column(0).to_numpy()
            keep = np.array([class_id(s) == c if len(s) else False for s, c in zip(shingle_sets(batch.column(1), size), want, strict=True)], bool)
            yield batch.filter(pa.array(keep))

    texts = docs.select("doc_id", "text").join(side, "doc_id").select("class", "text").mapInArrow(own, "class long, text string")
    texts = texts.groupBy("class").agg(F.min("text").alias("text"))
    with_b = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def verify(batches):
        for batch in batches:
            kept = [linked(x, y, common.value, percent, orders) for x, y in zip(shingle_sets(batch.column(2), size), shingle_sets(batch.column(3), size), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return both.mapInArrow(verify, "a long, b long")


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, class, component_id for each row of ``docs`` (doc_id, text).

    Rows with equal sets are one class. Classes link when 100 x intersection >= ``percent`` x union; component_id is the least doc_id that
    links reach. No pairs within a large group are made where one suffices: in two rounds each component (at first each class) is compared
    with one class, the most central one of the group that most of its tokens are in; then, exactly, every two
    classes of different components that share a token early enough are compared. Texts null or without words have no class, link with nothing and are
    their own component; repeated rows share a class; a null id is never a component's id unless it is alone; an empty table gives no rows."""
    rows, common = classes(docs, size)
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers
    members = cut(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")))
    tokens = prefixes(docs, shared, size, percent)
    many = rows.agg(F.coalesce(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1), F.lit(0.0))).first()[0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(int(many) // SORTED + 1, 20_000))
    groups = cut(met(tokens, tasks))
    tidy(docs.sparkSession)
    central = groups.groupBy("class").agg(F.count(F.lit(1)).alias("g"))  # a text without tokens of its own shares all of its prefix
    members = cut(members.join(central, "class", "left").withColumn("g", F.coalesce("g", F.lit(0))))
    labels, links = members.select("class", "n", "g", F.col("class").alias("root")), None
    for pick in (_stars, _stars, _across):
        labelled = groups.join(labels, "class")
        pairs = cut(pick(labelled, percent))
        if fits(pairs, 0):
            continue
        found = cut(compared(pairs, docs, members, shared, size, percent, orders))
        tidy(docs.sparkSession)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        labels = members.join(roots, F.col("class") == F.col("node"), "left").select("class", "n", "g", F.coalesce("root", "class").alias("root"))
    named = members.join(labels.select("class", "root"), "class")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("class", "component_id")
    return rows.join(of_class, "class", "left").select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def _stars(labelled: DataFrame, percent: int) -> DataFrame:
    """One pair (a, b) a component at most: a is the most central class of a token's group, b a class of the component in
    that group, the two that meet in most groups. Central is what shares the largest part of its prefix. Sizes must allow a link."""
    own = (F.col("n") - (F.col("n") * percent + 99).cast("long") / 100 + 1).alias("p")
    first = F.min(F.struct((-F.col("g") / own).alias("_g"), "class", "n", "root")).alias("_first")
    centres = labelled.groupBy("token").agg(first, F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("token", "_first")
    near = labelled.join(centres, "token").where((F.col("root") != F.col("_first.root")) & _sizes(F.col("n"), F.col("_first.n"), percent))
    counted = near.groupBy("root", F.col("_first.class").alias("a"), F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("s"))
    best = counted.groupBy("root").agg(F.max(F.struct("s", "a", "b")).alias("_best"))
    return best.select("_best.a", "_best.b")


def _sizes(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _across(labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a token early enough: the first token that two linked sets share
    leaves as many tokens after it, in both, as a link needs. Every pair that links shares such a token."""
    open_tokens = labelled.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("token")
    rows = cut(labelled.join(open_tokens, "token"))
    left = rows.select("token", F.col("class").alias("a"), F.col("n").alias("n"), F.col("at").alias("i"), F.col("root").alias("_ra"))
    right = rows.select("token", F.col("class").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("root").alias("_rb"))
    early = (100 + percent) * F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= percent * (F.col("n") + F.col("m"))
    pairs = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("_ra") != F.col("_rb")) & early)
    return pairs.select("a", "b").distinct()


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that link, directly or not, with a row of a smaller doc_id, and with equal rows once; same columns. Rows without an id stay."""
    joined = join(docs, **options)
    gone = cut(joined.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(F.broadcast(gone) if fits(gone, TEXT_IDS) else gone, "doc_id", "left_anti")
    again = joined.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if fits(again, 0):
        return kept
    key = kept.withColumn("_text", F.xxhash64("text"))
    return key.where("doc_id is not null").dropDuplicates(["doc_id", "_text"]).unionByName(key.where("doc_id is null")).drop("_text")

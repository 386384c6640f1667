"""Suffix-array dedup: bytes of texts covered by a ``LENGTH``-byte string that also starts anywhere else.

Equal strings are brought together by content. Each ``LENGTH``-byte window of a text is marked by the least hash
among its ``GRAM``-byte strings; neighbouring windows share a mark, so a text falls into runs of windows of some 100
bytes each, and equal windows always carry equal marks. A count-min screen of all marks leaves out runs whose mark
occurs once. The other runs are told by a digest of their bytes and counted: every window of a run that occurs twice
repeats. Different runs with one mark go to one shard, where a suffix array made by induced sorting and permuted
common prefixes find the windows they share. Runs of a mark too frequent for one shard are compared by digests of
their windows instead, which Spark counts. Only runs, never texts or groups of texts, are gathered in a shard.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm import hashing
from cordon.llm.screens import Screen, cells_for
from cordon.llm.suffixes import repeated_starts
from cordon.llm.text import slices
from cordon.session import cut

LENGTH = 400
GRAM = 200
SHARD_BYTES = 1 << 18  # of runs whose suffixes are sorted together
CHUNK = 1 << 20  # windows of one text that are marked at once
EMPTY = hashlib.sha256(b"").hexdigest()


def marks(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, mark, its place) of the runs of windows of ``data`` with one mark. Of equal hashes the first counts."""
    up, down = hashing.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(hashing._CODES[data] * up[: len(data)], out=total[1:])
    n = len(data) - gram + 1
    h = hashing.mix((total[gram:] - total[:n]) * down[:n])
    wide, windows = length - gram + 1, len(data) - length + 1
    key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // wide) * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    blocks = padded.reshape(-1, wide)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onward[:windows], upto[wide - 1 : wide - 1 + windows])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return start, np.diff(np.append(start, windows)), h[at[start]].view(np.int64), at[start] - start


def runs(column: pa.Array, length: int, gram: int):
    """(row, start, windows, mark, place arrays, bytes) of each text long enough, a ``CHUNK`` of windows at a time."""
    for row, text in enumerate(column):
        body = text.as_buffer() if text.is_valid else None
        if body is None or body.size < length:
            continue
        data = np.frombuffer(body, np.uint8)
        for lo in range(0, len(data) - length + 1, CHUNK):
            part = data[lo : lo + CHUNK + length - 1]
            start, windows, mark, place = marks(part, length, gram)
            yield row, start + lo, windows, mark, place, data


def other(mark: np.ndarray) -> np.ndarray:
    """A second hash of each mark."""
    return hashing.mix(mark.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def all_marks(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(x, y): both hashes of every run's mark."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = [mark for *_, mark, _, _ in runs(batch.column(0), length, gram)]
                if found:
                    x = np.concatenate(found)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(other(x))], names=["x", "y"])

    return texts.select("text").mapInArrow(run, "x long, y long")


def shared_runs(texts: DataFrame, screen: Screen, length: int, gram: int) -> DataFrame:
    """(key, start, windows, mark, place, run) of the runs whose mark may occur twice; run is a digest of their bytes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                keys, out = batch.column(0).to_pylist(), []
                for row, start, windows, mark, place, data in runs(batch.column(1), length, gram):
                    body = memoryview(data)
                    for i in np.flatnonzero(~screen.surely_fewer(mark, other(mark))).tolist():
                        a, n = int(start[i]), int(windows[i])
                        out.append((keys[row], a, n, int(mark[i]), int(place[i]), hashlib.blake2b(body[a : a + n + length - 1], digest_size=16).digest()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["key", "start", "windows", "mark", "place", "run"])

    return texts.select("key", "text").mapInArrow(run, "key binary, start long, windows long, mark long, place long, run binary")


def with_keys(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """One text of each key of ``rows``, and these; ``rows`` has a row a key. A screen keeps texts of other keys
    from being shuffled."""
    screen = Screen(rows, F.xxhash64("key"), F.xxhash64("key", F.lit(1)), least=1)

    @F.pandas_udf("boolean")
    def wanted(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(~screen.surely_fewer(x.to_numpy(), y.to_numpy()))

    near = texts.where(wanted(F.xxhash64("key"), F.xxhash64("key", F.lit(1))))
    return near.groupBy("key").agg(F.first("text").alias("text")).join(rows, "key")


def cut_out(texts: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """(run, mark, place, hot, body) of the runs of ``needed`` (key, start, windows, run, mark, place, hot)."""
    wanted = needed.groupBy("key").agg(F.collect_list(F.struct("start", "windows", "run", "mark", "place", "hot")).alias("runs"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                out = []
                for text, found in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                    body = memoryview(text.as_buffer())
                    out += [(r["run"], r["mark"], r["place"], r["hot"], body[r["start"] : r["start"] + r["windows"] + length - 1].tobytes()) for r in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["run", "mark", "place", "hot", "body"])

    return with_keys(texts, wanted).select("text", "runs").mapInArrow(run, "run binary, mark long, place long, hot boolean, body binary")


def stretches(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each gapless stretch of sorted whole numbers."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, breaks + 1)].tolist(), starts[np.append(breaks, len(starts) - 1)].tolist(), strict=True))


def alike(a: bytes, b: bytes) -> int:
    """How many bytes two strings start with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def promising(bodies: list[bytes], places: list[int], length: int) -> list[tuple[int, int]]:
    """Of each run with one mark, the first and last start of a string that another may share: one that reaches no
    further left and right of the mark than some other run agrees with this one. Last is before first for none."""
    reach = []
    for sides in ([b[p:] for b, p in zip(bodies, places, strict=True)], [b[:p][::-1] for b, p in zip(bodies, places, strict=True)]):
        order = sorted(range(len(sides)), key=sides.__getitem__)
        far = [0] * len(sides)
        for i, j in zip(order, order[1:]):
            n = alike(sides[i], sides[j])
            far[i], far[j] = max(far[i], n), max(far[j], n)
        reach.append(far)
    return [(max(0, p - left), min(len(b) - length, p + right - length)) for b, p, right, left in zip(bodies, places, *reach, strict=True)]


def by_suffixes(bodies: DataFrame, shards: int, length: int) -> DataFrame:
    """(run, first, last): stretches of windows that other runs of the same shard hold too."""

    def shard(table: pa.Table) -> pa.Table:
        names, marked, places, bodies = (table.column(c).to_pylist() for c in ("run", "mark", "place", "body"))
        groups, kept, out = defaultdict(list), [], []
        for i, mark in enumerate(marked):
            groups[mark].append(i)
        for own in groups.values():
            spans = promising([bodies[i] for i in own], [places[i] for i in own], length)
            kept += [(names[i], a, bodies[i][a : b + length]) for i, (a, b) in zip(own, spans, strict=True) if a <= b]
        for (name, shift, _), starts in zip(kept, repeated_starts([body for *_, body in kept], length), strict=True):
            out += [(name, a + shift, b + shift) for a, b in stretches(starts)]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["run", "first", "last"])

    dealt = bodies.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards))).repartition(-(-shards // 4), "shard")
    return dealt.groupBy("shard").applyInArrow(shard, "run binary, first long, last long")


def by_digests(bodies: DataFrame, length: int) -> DataFrame:
    """The same for runs of very frequent marks: their windows are counted by digest, with partial counts a task."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1 << 16):
                names, at, found = [], [], []
                for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    n = len(body) - length + 1
                    names += [name] * n
                    at += range(n)
                    found += [hashlib.blake2b(body[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(at, pa.int64()), pa.array(found, pa.binary())], names=["run", "at", "digest"])

    windows = cut(bodies.select("run", "body").mapInArrow(run, "run binary, at long, digest binary"))
    often = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return windows.join(often, "digest").select("run", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, cells: int | None = None) -> DataFrame:
    """(key, spans) of the ``texts`` (key, text: binary; a key stands for one text, rows of one key are copies) that
    hold a ``length``-byte string found twice or more: the stretches (first, last) of such strings' starts, unordered."""
    if cells is None:  # about four for each run
        cells = cells_for(8 * (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (length - gram + 1))
    sketch = all_marks(texts, length, gram)
    screen = Screen(sketch, F.col("x"), F.col("y"), cells)
    found = cut(shared_runs(texts, screen, length, gram))
    # equal bytes have equal marks, save at the edges of a chunk of a long text
    kinds = found.groupBy("run", "mark").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start", "windows", "place")).alias("_at"))
    kinds = cut(kinds.select("run", "mark", "n", "_at.*"))
    full = kinds.where("n > 1").select("run", F.lit(0).cast("long").alias("first"), (F.col("windows") - 1).alias("last"))
    size = F.sum(F.col("windows") + length)
    groups = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), size.alias("size")).where("k > 1 AND least = 1")
    needed = cut(kinds.join(groups.select("mark", (F.col("size") > shard_bytes).alias("hot")), "mark").select("run", "mark", "key", "start", "windows", "place", "hot"))
    total = needed.where("NOT hot").agg(size).first()[0] or 0
    bodies = cut(cut_out(texts, needed, length))
    parts = by_suffixes(bodies.where("NOT hot"), max(1, 2 * total // shard_bytes), length).unionByName(by_digests(bodies.where("hot"), length))
    flags = full.unionByName(parts)
    spans = found.select("key", "start", "run").distinct().join(flags, "run").select("key", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def covered(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (start, end) that strings starting in ``spans`` cover."""
    out = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(x) for x in out]


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, cells: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, spans (removed byte ranges, end
    exclusive) and kept_sha256.

    Null texts are empty; texts shorter than ``length`` keep everything; repeated rows and copies lose every byte
    that is ``length`` long at least. A null doc_id is kept as such. Very long texts are marked in chunks, and one
    text is held by a task at a time. An empty table gives no rows; other columns of ``docs`` are ignored."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    whole = F.sha2(text, 256)
    rows = docs.select("doc_id", text.alias("text"), whole.alias("_sha"), F.unhex(F.substring(whole, 1, 32)).alias("key"))
    texts = rows.select("key", "text").where(F.octet_length("text") >= length)
    spans = cut(repeated(texts, length, gram, shard_bytes, cells))

    def run(batches):
        for whole_batch in batches:
            for batch in slices(whole_batch):
                out = []
                for key, body, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    view, digest, at = memoryview(body.as_buffer()), hashlib.sha256(), 0
                    gone = covered(found, length)
                    for a, b in gone:
                        digest.update(view[at:a])
                        at = b
                    digest.update(view[at:])
                    out.append((key, [{"start": a, "end": b} for a, b in gone], digest.hexdigest()))
                if out:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), kind, pa.string()), strict=True)], names=["key", "spans", "kept_sha256"])

    changed = with_keys(texts, spans).select("key", "text", "spans").mapInArrow(run, "key binary, spans array<struct<start:long,end:long>>, kept_sha256 string")
    out = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "_sha", "key").join(changed, "key", "left")
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"))

"""Structured Streaming forms. Event time is ``date_collected``; rows later than
the watermark reach the store but raise no alert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cordon.operators import alerts as a
from cordon.plans.ingest import Dictionaries, staged
from cordon.session import micros
from cordon.sources.ingest_rows import insert_new

LATE = "1 hour"


def _watermarked(df: DataFrame, at: str = "date_collected", delay: str = LATE) -> DataFrame:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def dedup_stream(df: DataFrame, key: str = "source_url", at: str = "date_collected", delay: str = LATE) -> DataFrame:
    """First row of each key within the delay; state is dropped behind the watermark."""
    return _watermarked(df, at, delay).dropDuplicatesWithinWatermark([key])


def spike_stream(inc: DataFrame, min_events: int = 3) -> DataFrame:
    """Busiest region per country over sliding half hours; the batch form's plan."""
    return a.spike_windows(_watermarked(inc), min_events)


def burst_stream(inc: DataFrame, min_events: int = 3) -> DataFrame:
    return a.burst_windows(_watermarked(inc), min_events)


def hotspot_stream(inc: DataFrame, min_events: int = 5) -> DataFrame:
    """Week windows moving by a day; a finer slide would copy each row too often."""
    return a.hotspot_windows(_watermarked(inc), min_events)


def critical_stream(inc: DataFrame) -> DataFrame:
    """One alert per critical event, however often the event is delivered."""
    hot = _watermarked(inc.where(F.col("severity") == "critical")).dropDuplicatesWithinWatermark(["id"])
    return hot.select(*a._critical_cols(F.col("date_collected")))


def _replace(df: DataFrame, batch_id: int, path: str, fmt: str = "parquet") -> None:
    """Write a batch as its own partition, in place of what an earlier attempt at the same batch left there."""
    df.withColumn("batch", F.lit(batch_id)).write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").save(path)


def _stored_before(batch: DataFrame, batch_id: int, path: str, like: DataFrame, since_days: int | None) -> DataFrame:
    """Keys that other batches have stored: one column, and only files of late enough days, if these are enough."""
    try:
        stored = batch.sparkSession.read.parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.select("source_url").limit(0)  # nothing stored yet
    stored = stored.where(F.col("batch") != batch_id)
    if since_days is not None:
        first = like.agg(F.min("date_collected")).first()[0]
        stored = stored.where(F.col("date_collected") >= F.lit(first) - F.expr(f"interval {int(since_days)} days")) if first else stored
    return stored.select("source_url")


def write_batch(batch: DataFrame, batch_id: int, refs: Dictionaries, store: str, rejects: str, to_rows, since_days: int | None = None, **options) -> None:
    """One micro-batch through the ingest chain. A batch that is repeated after a failure, at any point, replaces its
    own rows and is compared with the rows of other batches only, so nothing is stored twice or lost."""
    done = staged(batch, refs, **options).persist()
    try:
        ok = to_rows(done.where("reject_reason is null"))
        _replace(insert_new(ok, _stored_before(batch, batch_id, store, ok, since_days)), batch_id, store)
        _replace(done.where("reject_reason is not null").select("source_url", "reject_reason"), batch_id, rejects)
    finally:
        done.unpersist()


def ingest_stream(raw: DataFrame, refs: Dictionaries, store: str, rejects: str, checkpoint: str, to_rows, since_days: int | None = None, **options):
    """Run the ingest chain on every micro-batch and store what is new, exactly once. ``to_rows`` maps passed rows to
    the store's columns. ``since_days`` looks for a row's URL only that far back from the batch's earliest row."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, refs, store, rejects, to_rows, since_days, **options)

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def write_both(batch: DataFrame, batch_id: int, incidents: str, roads: str) -> None:
    """Both sinks of one micro-batch; a repeated batch replaces itself in each."""
    batch.persist()
    try:
        _replace(batch.where("stream_incident"), batch_id, incidents, "json")
        _replace(batch.where("stream_road"), batch_id, roads, "json")
    finally:
        batch.unpersist()


def dual_sink(msgs: DataFrame, incidents: str, roads: str, checkpoint: str):
    """Both streams of flagged messages from one read of each batch, exactly once."""
    return msgs.writeStream.foreachBatch(lambda batch, batch_id: write_both(batch, batch_id, incidents, roads)).option("checkpointLocation", checkpoint)


# --- throttle ----------------------------------------------------------------

class _Throttle(StatefulProcessor):
    """Value state: the last kept time. ``ordered`` also holds messages, by time bucket, until the watermark has passed
    their bucket. A timer at the end of the gap forgets the last kept time, which by then can't hold anything back."""

    def __init__(self, gap: int, width: int | None):
        self.gap, self.width = gap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.held = handle.getMapState("held", "bucket long", "us array<long>, id array<long>")

    def close(self) -> None:
        pass

    def _pick(self, us: np.ndarray, ids: np.ndarray) -> tuple[list[int], list[int]]:
        """What is kept of messages in order, after the last kept one."""
        last = self.last.get()[0] if self.last.exists() else None
        kept, i = [], 0 if last is None else int(np.searchsorted(us, last + self.gap))
        while i < len(us):
            kept.append(i)
            i = int(np.searchsorted(us, us[i] + self.gap))
        if kept:
            last = int(us[kept[-1]])
            self.last.update((last,))
            self.handle.registerTimer((last + self.gap) // 1000 + 1)
        return us[kept].tolist(), ids[kept].tolist()

    def _out(self, key, us: list[int], ids: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "at": pd.to_datetime(np.array(us, "int64"), unit="us"), "id": np.array(ids, "int64")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, ids = np.empty(0, "int64"), np.empty(0, "int64")
        for pdf in rows:
            new = pdf["at"].to_numpy().astype("datetime64[us]").astype("int64")
            if self.width is None:
                us, ids = _firsts(np.concatenate([us, new]), np.concatenate([ids, pdf["id"].to_numpy("int64")]))
                continue
            fresh = new >= timerValues.getCurrentWatermarkInMs() * 1000
            self._hold(new[fresh], pdf["id"].to_numpy("int64")[fresh])
        if len(us):
            yield self._out(key, *self._pick(us, ids))

    def _hold(self, us: np.ndarray, ids: np.ndarray) -> None:
        buckets = us // self.width
        for b in np.unique(buckets).tolist():
            mine = buckets == b
            had = self.held.getValue((b,)) if self.held.containsKey((b,)) else ([], [])
            t, i = _firsts(np.concatenate([np.array(had[0], "int64"), us[mine]]), np.concatenate([np.array(had[1], "int64"), ids[mine]]))
            self.held.updateValue((b,), (t.tolist(), i.tolist()))
            self.handle.registerTimer(-(-(b + 1) * self.width // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if self.width is not None:
            for b in sorted(k[0] for k in self.held.keys() if (k[0] + 1) * self.width <= now):
                us, ids = (np.array(c, "int64") for c in self.held.getValue((b,)))
                self.held.removeKey((b,))
                kept = self._pick(us, ids)
                if kept[0]:
                    yield self._out(key, *kept)
        if self.last.exists() and self.last.get()[0] + self.gap < now:
            self.last.clear()


def _firsts(us: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times in order, each once, with the smallest id."""
    order = np.lexsort((ids, us))
    us, first = np.unique(us[order], return_index=True)
    return us, ids[order][first]


def _stateful(df: DataFrame) -> DataFrame:
    """State with timers needs the store on disk, which also keeps it out of the executor's heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df


def throttle(df: DataFrame, key: str, at: str, gap_s: float = 1.0, delay: str = "1 minute", bucket_s: float | None = None) -> DataFrame:
    """Per key, keep a message if the last kept one is at least a gap older; of messages of one time, the smallest id.

    At once (default): messages are judged as micro-batches bring them; a message older than the last kept one goes.
    With ``bucket_s``: messages wait until the watermark passes their bucket of that many seconds and are judged by
    event time, so that any order of arrival within ``delay`` gives the rows of ``throttle_batch``. A task holds the
    times and ids of one key's micro-batch, or of one bucket."""
    width = None if bucket_s is None else int(bucket_s * 1_000_000)
    src = df.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col("id").cast("long").alias("id")).withWatermark("at", delay)
    return _stateful(src).groupBy("key").transformWithStateInPandas(
        _Throttle(int(gap_s * 1_000_000), width), "key string, at timestamp, id long", "Append", "EventTime")


def throttle_batch(df: DataFrame, key: str, at: str, gap_s: float = 1.0, bucket_s: int = 600) -> DataFrame:
    """The same answer over a table, with busy keys cut into time buckets. What a
    bucket keeps depends on the past only through its first kept message, and few
    messages can be that one; so each bucket maps first-kept to last-kept, a short
    fold per key over those maps picks the true one, and buckets finish apart."""
    gap, width = int(gap_s * 1_000_000), bucket_s * 1_000_000
    base = df.select(F.col(key).cast("string").alias("key"), micros(at).alias("us"), F.col("id").cast("long").alias("id"))
    base = base.where(F.col("key").isNotNull() & F.col("us").isNotNull())
    one = base.groupBy("key", "us").agg(F.min("id").alias("id")).withColumn("b", F.floor(F.col("us") / F.lit(width)).cast("long"))

    def ends(batches):
        for d in whole_groups(batches, ["key", "b"]):
            us, group = d["us"].to_numpy(), _numbered(d, ["key", "b"])
            to = _jumps(group, us, gap)
            last = np.where(to < 0, np.arange(len(us)), to)
            while (to[last] >= 0).any():
                last = last[last]
            early = us - d["b"].to_numpy() * width <= gap
            may = np.r_[True, (group[1:] != group[:-1]) | early[:-1]]
            yield pd.DataFrame({"key": d["key"], "b": d["b"], "first": us, "last": us[last]})[may]

    maps = _dealt(one, ["key", "b"], "us").mapInPandas(ends, "key string, b long, first long, last long")

    def pick(batches):
        for d in whole_groups(batches, ["key"]):
            group = _numbered(d, ["key"])
            to = _jumps(group, d["first"].to_numpy(), gap, d["last"].to_numpy())
            yield d.iloc[_walk(np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), to)][["key", "b", "first"]]

    firsts = _dealt(maps, ["key"], "first").mapInPandas(pick, "key string, b long, first long")

    def orbit(batches):
        for d in whole_groups(batches, ["key", "b"]):
            us = d["us"].to_numpy()
            to = _jumps(_numbered(d, ["key", "b"]), us, gap)
            yield d.iloc[_walk(np.flatnonzero(us == d["first"].to_numpy()), to)][["key", "us", "id"]]

    return _dealt(one.join(firsts, ["key", "b"]), ["key", "b"], "us").mapInPandas(orbit, "key string, us long, id long")


def _dealt(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Groups of ``by`` side by side and each in order of ``at``; a task takes many groups at a time."""
    return df.repartition(*by).sortWithinPartitions(*by, at)


def whole_groups(batches, by: list[str]):
    """The rows of sorted batches again, with no group of ``by`` torn. A task holds a batch, or a group where that is larger."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if b.empty:
            continue
        last = np.logical_and.reduce([(b[c] == b[c].iloc[-1]).to_numpy() for c in by])
        start = int(np.argmax(last))
        if start or (held and any(held[-1][c].iloc[-1] != b[c].iloc[0] for c in by)):
            yield pd.concat([*held, b.iloc[:start]], ignore_index=True)
            held = []
        held.append(b.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _numbered(d: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Groups of sorted rows, numbered from 0."""
    new = np.logical_or.reduce([(d[c] != d[c].shift()).to_numpy() for c in by])
    return np.cumsum(new) - 1


def _jumps(group: np.ndarray, at: np.ndarray, gap: int, since: np.ndarray | None = None) -> np.ndarray:
    """For each row, the first one of its group at least a gap after ``since`` (its own time by default); -1 for none."""
    low = int(at.min())
    off, want = at - low, (at if since is None else since) - low + gap
    span = int(max(off.max(), want.max())) + 1
    to, step = np.full(len(at), -1), max(1, (1 << 62) // span)  # groups in a row on one axis, as many as 64 bits hold
    for g in range(0, int(group[-1]) + 1, step):
        lo, hi = np.searchsorted(group, g), np.searchsorted(group, g + step)
        axis = (group[lo:hi] - g) * span
        found = lo + np.searchsorted(axis + off[lo:hi], axis + want[lo:hi])
        own = found < hi
        own[own] = group[found[own]] == group[lo:hi][own]
        to[lo:hi] = np.where(own, found, -1)
    return to


def _walk(starts: np.ndarray, to: np.ndarray) -> list[int]:
    """All rows that the jumps lead to, from each start on."""
    ahead, kept = to.tolist(), []
    for i in starts.tolist():
        while i >= 0:
            kept.append(i)
            i = ahead[i]
    return kept


# --- one alert a country ---

def one_per_country(windows: DataFrame, gap_s: float = 1800.0) -> DataFrame:
    """Of alert windows (``spike_windows``, ``burst_windows``), those that raise an alert: a country's next one ends
    at least a gap after the last one kept."""
    ends = windows.select("country_code", "win_end", F.lit(0).alias("id"))
    kept = throttle_batch(ends, "country_code", "win_end", gap_s, bucket_s=max(600, int(4 * gap_s)))
    kept = kept.select(F.col("key").alias("country_code"), F.col("us").alias("_us"))
    return windows.withColumn("_us", micros("win_end")).join(kept, ["country_code", "_us"]).drop("_us")


def write_alerts(batch: DataFrame, batch_id: int, path: str, gap_s: float = 1800.0) -> None:
    """The same for a micro-batch of closed windows, after what earlier batches kept: the store is the state, one row
    a country is read from it, and a repeated batch replaces its own alerts."""
    last = batch.select("country_code").limit(0).withColumn("_last", F.lit(None).cast("long"))
    try:
        stored = batch.sparkSession.read.parquet(path).where(F.col("batch") < batch_id)
        last = stored.groupBy("country_code").agg(F.max(micros("win_end")).alias("_last"))
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
    late = batch.join(last, "country_code", "left").where(F.col("_last").isNull() | (micros("win_end") - F.col("_last") >= int(gap_s * 1_000_000)))
    _replace(one_per_country(late.drop("_last"), gap_s), batch_id, path)


def alert_stream(windows: DataFrame, path: str, checkpoint: str, gap_s: float = 1800.0):
    """At most one alert a country and gap, from a stream of closed windows."""
    return windows.writeStream.foreachBatch(lambda batch, batch_id: write_alerts(batch, batch_id, path, gap_s)).option("checkpointLocation", checkpoint)


# --- staleness ---------------------------------------------------------------

class _Watch(StatefulProcessor):
    """Value state: the heartbeats that the watermark has not passed yet, and the last one before them. Timers settle
    them in event time, so that the order of arrival within the delay does not matter."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.beats = handle.getValueState("beats", "ms array<long>")

    def close(self) -> None:
        pass

    def _keep(self, ms: list[int]) -> None:
        if not ms:
            self.beats.clear()
            return
        self.beats.update((ms,))
        self.handle.registerTimer(ms[-1])
        self.handle.registerTimer(ms[0] + self.limit)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ms = np.array(self.beats.get()[0] if self.beats.exists() else [], "int64")
        for pdf in rows:
            ms = np.unique(np.concatenate([ms, pdf["at"].to_numpy().astype("datetime64[ms]").astype("int64")]))
        self._keep(ms.tolist())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, ms = expiredTimerInfo.getExpiryTimeInMs(), self.beats.get()[0] if self.beats.exists() else []
        stale, i = [], 0
        while i < len(ms) and (ms[i] + self.limit <= now or (i + 1 < len(ms) and ms[i + 1] <= now)):
            if i + 1 == len(ms) or ms[i + 1] - ms[i] > self.limit:
                stale.append(ms[i])
            i += 1
        if i:
            self._keep(ms[i:])
        if stale:
            yield pd.DataFrame({"country_code": key[0], "agent_type": key[1], "last_heartbeat": pd.to_datetime(stale, unit="ms")})


def stale_stream(beats: DataFrame, limit_s: int = 300, delay: str = "10 seconds") -> DataFrame:
    """A row for every silence: the last heartbeat of an agent that has none in the ``limit_s`` after it, once event
    time has passed them; ``beats`` is ``(country_code, agent_type, at)``."""
    src = beats.select("country_code", "agent_type", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    return _stateful(src).groupBy("country_code", "agent_type").transformWithStateInPandas(
        _Watch(limit_s * 1000), "country_code string, agent_type string, last_heartbeat timestamp", "Append", "EventTime")


def silences(beats: DataFrame, as_of, limit_s: int = 300) -> DataFrame:
    """The same over a table, as of a moment, to the millisecond."""
    ms = F.floor(micros("at") / 1000)
    after = F.lead("_ms").over(Window.partitionBy("country_code", "agent_type").orderBy("_ms"))
    one = beats.select("country_code", "agent_type", ms.alias("_ms")).distinct().withColumn("_next", after)
    last = F.timestamp_millis("_ms").cast("timestamp_ntz")
    silent = F.when(F.col("_next").isNull(), F.floor(micros(as_of) / 1000) >= F.col("_ms") + limit_s * 1000).otherwise(F.col("_next") - F.col("_ms") > limit_s * 1000)
    return one.where(silent).select("country_code", "agent_type", last.alias("last_heartbeat"))

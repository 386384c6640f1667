"""Greedy spatial clusters, computed exactly and in parallel.

The definition is sequential: events are visited in (time, id) order; an event
not yet taken opens a cluster of all later, untaken events within reach, if
those are at least ``min_events``; otherwise it is left alone for good.

Three facts make it parallel without changing the result.
* Events at one spot share their fate, so each spot is one row: its first event,
  its event count, and (only when it holds fewer than ``min_events``) its order
  keys. A hot spot is a single row however many events it has.
* A spot gets one chance, at its first event: a later event there sees a subset.
* A chance depends only on spots within twice the reach. So a spot can be decided
  as soon as no earlier spot there is open.
Rounds deal the spots that no cluster has taken into tiles of space (and time), and
each tile replays the rule in order: a spot within twice the reach of the tile's edge,
or of an earlier spot in doubt, stays in doubt, all others are decided. The next round
shifts the tiles along another axis, so that every spot is away from
the edges in one round of each cycle; each cycle thus decides at least the first open spot, and
in practice nearly all. Tiles follow the load: spots are counted by wide tile before each round, and a tile
with more than ``LOAD`` of them is dealt as narrow tiles, so that tasks grow in number with the data. A round is
one shuffle of spots. A task holds one tile's spots, whose
area is bounded by the reach. The driver only sees whether a spot is open.

With a reach in time (``days``) a place opens again and again, so the rule is replayed a place, not a spot, at a time: what a
place has lost is one horizon, the end of the last cluster that reached it, and its next event is found past that by
bisection. A tile thus takes as many steps as there are clusters and places, however many events they have. Where tiles do
not see all, horizons are bounds: an event that is free at the highest bound, with enough events left at it, surely opens a
cluster; one with too few at the lowest surely does not; from any other on the place may open clusters, which
raises the highest bound of all within its reach. The next round replays with the clusters found so far as facts. The first
open event of all has no doubt before it, so a cycle decides it at least.
"""

from __future__ import annotations

import heapq
import itertools
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cordon.functions.geo import KM_PER_DEG, RADIUS_KM
from cordon.session import cut, micros

DAY_US = 86_400_000_000
WIDE = 40  # reaches in a wide tile's width, which takes fewer rounds
PARTS = 4  # narrow tiles across a wide one: ten reaches each; from eight up every spot is away from the edges once
LOAD = 4096  # a wide tile with more spots (or places) is split into narrow ones
EVENTS = 64  # and so is one with more than this many times LOAD events
SHIFT = 0.625  # of a wide tile: 2.5 narrow ones, so that both grids move their edges far enough
SAFE = 1.000001  # distances to edges are compared with a margin for rounding
SHIFTS = [(y, x) for y in (0.0, SHIFT) for x in (0.0, SHIFT)]
ID_CHARS = 64
TASK = 500_000  # events for which another task is made, beyond one a core


def _spots(events: DataFrame, where: list[str], min_events: int) -> DataFrame:
    spots = events.groupBy(*where).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("cnt"))
    if min_events <= 1:
        return spots.withColumn("late", F.array().cast("array<string>"))
    few = spots.where(F.col("cnt") < min_events).select(*where)
    keys = (
        events.join(few, where, "left_semi")
        .groupBy(*where)
        .agg(F.sort_array(F.collect_list("key")).alias("late"))  # fewer than min_events entries
    )
    return spots.join(keys, where, "left").withColumn("late", F.coalesce("late", F.array().cast("array<string>")))


def greedy_clusters(
    df: DataFrame,
    id_col: str,
    ts_col: str,
    lat_col: str = "latitude",
    lon_col: str = "longitude",
    radius_km: float = 30.0,
    min_events: int = 3,
    days: int | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """``(by…, id, seed_id)``: every clustered event with the event that opened
    its cluster. ``days`` adds a reach in time; ``by`` keeps groups apart."""
    by = by or []
    us = micros(F.col(ts_col).cast("timestamp_ntz"))
    pad = F.lpad(F.col(id_col).cast("string"), ID_CHARS, "0")
    known = df.where(F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull() & F.col(ts_col).isNotNull())
    at = [*by, F.col(lat_col).cast("double").alias("lat"), F.col(lon_col).cast("double").alias("lon")]
    if days is not None:
        return _timed(known.select(*at, us.alias("us"), F.col(id_col).alias("id")), by, radius_km, min_events, days)
    key = F.concat(F.lpad((us + F.lit(1 << 62)).cast("string"), 20, "0"), pad)
    events = known.select(*at, key.alias("key"), F.col(id_col).alias("id"))  # the key sorts as (time, id)
    where = [*by, "lat", "lon"]
    spots = _spots(events, where, min_events)
    state = spots.withColumn("tried", F.lit(False)).withColumn("seed", F.lit(None).cast("string"))
    schema = state.schema
    taken = None
    for shift in itertools.cycle(SHIFTS):
        placed = state.withColumn("_wide", _wide(by, radius_km, shift))
        full = placed.groupBy("_wide").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LOAD).select("_wide", F.lit(True).alias("_full"))
        dealt = _dealt(state, full, by, radius_km, shift, 2)
        state = cut(dealt.groupBy(*by, "tile").applyInPandas(_replay(list(schema.names), radius_km, min_events), schema))
        found = state.where(F.col("seed").isNotNull()).select(*where, "seed")
        taken = found if taken is None else taken.unionByName(found)
        state = state.where(F.col("seed").isNull())
        if state.where(~F.col("tried")).isEmpty():
            break
    members = events.join(taken, where).where(F.col("key") >= F.col("seed"))
    seeds = events.select(*by, F.col("key").alias("seed"), F.col("id").alias("seed_id")).join(taken.select(*by, "seed").distinct(), [*by, "seed"], "left_semi")
    return members.join(seeds, [*by, "seed"]).select(*by, "id", "seed_id")


def _timed(known: DataFrame, by: list[str], radius_km: float, min_events: int, days: int) -> DataFrame:
    """``greedy_clusters`` with a reach in time. Of the events of one place and moment the first ``min_events`` are enough."""
    place, span = [*by, "lat", "lon"], days * DAY_US
    pad = F.lpad(F.col("id").cast("string"), ID_CHARS, "0")
    events = known.where((F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf")))
    moment = Window.partitionBy(*place, "us").orderBy("_pad", "id")
    few = events.withColumn("_pad", pad).withColumn("_rn", F.row_number().over(moment)).where(F.col("_rn") <= max(1, min_events))
    rows = cut(few.select(*place, "us", "id", F.col("id").cast("string").alias("name")))
    cover = T.StructType([T.StructField("us", T.LongType()), T.StructField("pad", T.StringType()), known.select("id").schema["id"]])
    state = rows.groupBy(*place).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumns(
        {"done": F.lit(0), "covers": F.array().cast(T.ArrayType(cover))})
    schema = state.schema
    parts = max(known.sparkSession.sparkContext.defaultParallelism, rows.count() // TASK)
    state, rows = cut(state), rows.select(*[F.col(c).alias(c) for c in rows.columns])  # told apart when they meet
    for shift in itertools.cycle(SHIFTS):
        open_ = F.col("done") < F.col("n")
        full = state.groupBy(_wide(by, radius_km, shift).alias("_wide")).agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_events")).where(
            (F.col("_n") > LOAD) | (F.col("_events") > EVENTS * LOAD)).select("_wide", F.lit(True).alias("_full"))
        dealt = _dealt(state, full, by, radius_km, shift, 1)
        left = dealt.where(open_).select(F.struct(*by, "tile").alias("_tile")).distinct()
        tile = F.struct(*by, "tile")
        asked = dealt.withColumn("_tile", tile).join(left, "_tile", "left_semi").drop("_tile")
        shut = dealt.withColumn("_tile", tile).join(left, "_tile", "left_anti").select(*schema.names)
        seen = _dealt(rows, full, by, radius_km, shift, 1).withColumn("_tile", tile).join(left, "_tile", "left_semi").drop("_tile", "inner")
        replay = _replay_places(by, schema, radius_km, min_events, span)
        # tiles are small and slow, so they are dealt to a fixed number of tasks, not by their bytes
        seen, asked = (d.repartition(parts, *by, "tile").groupBy(*by, "tile") for d in (seen, asked))
        state = cut(seen.cogroup(asked).applyInArrow(replay, schema).unionByName(shut))
        if state.where(open_).isEmpty():
            break
    step = max(1, span)  # a cluster's time touches two steps at most
    order = Window.partitionBy(*place).orderBy("c.us", "c.pad")
    took = state.select(*place, F.explode("covers").alias("c")).withColumn("_past", F.lag("c.us").over(order) + F.lit(span))
    took = took.withColumn("_step", F.explode(F.array_distinct(F.array(*[F.floor((F.col("c.us") + F.lit(d)) / F.lit(step)) for d in (0, span)]))))
    later = (F.col("us") > F.col("c.us")) | ((F.col("us") == F.col("c.us")) & (pad >= F.col("c.pad")))
    within = (F.col("us") <= F.col("c.us") + F.lit(span)) & (F.col("_past").isNull() | (F.col("us") > F.col("_past")))
    met = events.withColumn("_step", F.floor(F.col("us") / F.lit(step))).join(took, [*place, "_step"])
    return met.where(later & within).select(*by, "id", F.col("c.id").alias("seed_id"))


def _wide(by: list[str], radius_km: float, shift: tuple[float, float]) -> Column:
    return F.struct(*by, _tile(radius_km, *shift, 1, 0)[0].alias("at"))


def _dealt(state: DataFrame, full: DataFrame, by: list[str], radius_km: float, shift: tuple[float, float], reach: int) -> DataFrame:
    """``state`` with its tile and inner: the wide one, or the narrow one within it where the wide one is full."""
    wide, narrow = _tile(radius_km, *shift, 1, reach), _tile(radius_km, *shift, PARTS, reach)
    split = F.col("_full").isNotNull()
    return state.withColumn("_wide", _wide(by, radius_km, shift)).join(full, "_wide", "left").withColumns({
        "tile": F.when(split, narrow[0]).otherwise(wide[0]), "inner": F.when(split, narrow[1]).otherwise(wide[1])}).drop("_wide", "_full")


def _tile(radius_km: float, oy: float, ox: float, parts: int, reach: int) -> tuple[Column, Column]:
    """The tile of a spot, ``parts`` of them across a wide one, and whether all within ``reach`` times the radius is in it.
    Rows of latitude are cut into whole numbers of columns around the globe; rows near a pole are not cut."""
    high, need = WIDE * radius_km / KM_PER_DEG, reach * radius_km * SAFE
    lat, lon = F.col("lat"), F.col("lon")
    y = (lat + 90) / high + oy
    row = F.floor(y)
    top = F.greatest(F.abs((row - oy) * high - 90), F.abs((row + 1 - oy) * high - 90))
    fit = F.floor(F.cos(F.radians(top)) * 360 / high)
    n = F.when((top >= 88) | (fit < 1), F.lit(1)).otherwise(parts * fit)
    x = F.pmod(lon + 180, F.lit(360.0)) / 360 * n + ox * F.when(n == 1, F.lit(1)).otherwise(F.lit(parts))
    y = y * parts
    ty = F.floor(y)
    edge = F.least(F.least(x - F.floor(x), F.floor(x) + 1 - x) * 360 / n, F.lit(90.0))
    aside = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(edge))) * RADIUS_KM
    inner = (F.least(y - ty, ty + 1 - y) / parts * high * KM_PER_DEG >= need) & ((n == 1) | (aside >= need))
    return F.struct(F.lit(parts).alias("of"), ty.alias("y"), F.pmod(F.floor(x), n).alias("x")), inner


def _near(lat: np.ndarray, lon: np.ndarray, i: int, of: np.ndarray, km: float) -> np.ndarray:
    """Those for which ``of`` holds, at most ``km`` from i, of points in order of latitude (all in radians)."""
    band = km / RADIUS_KM * SAFE
    lo, hi = np.searchsorted(lat, lat[i] - band), np.searchsorted(lat, lat[i] + band, side="right")
    near = lo + np.flatnonzero(of[lo:hi])
    h = np.sin((lat[near] - lat[i]) / 2) ** 2 + np.cos(lat[i]) * np.cos(lat[near]) * np.sin((lon[near] - lon[i]) / 2) ** 2
    return near[2 * RADIUS_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h))) <= km]


def _replay(names: list[str], radius_km: float, min_events: int):
    """The serial rule on one tile, as far as it is sure there."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["tried"].all():
            return pdf[names]
        pdf = pdf.sort_values("lat").reset_index(drop=True)
        lat, lon = np.radians(pdf["lat"].to_numpy()), np.radians(pdf["lon"].to_numpy())
        cnt, first = pdf["cnt"].to_numpy(), pdf["first"].to_numpy()
        late, inner, tried = pdf["late"].to_numpy(), pdf["inner"].to_numpy(), pdf["tried"].to_numpy().copy()
        order = np.argsort(first, kind="stable")
        rank = np.empty(len(order), dtype="int64")
        rank[order] = np.arange(len(order))
        free, doubt, seed = np.ones(len(pdf), dtype=bool), np.zeros(len(pdf), dtype=bool), np.full(len(pdf), None, dtype=object)

        def within(i: int, of: np.ndarray, reach: float) -> np.ndarray:
            """Spots for which ``of`` holds, at most ``reach`` times the radius from spot i."""
            return _near(lat, lon, i, of, reach * radius_km)

        for i in order:
            if tried[i] or not free[i]:
                continue
            if not inner[i] or len(within(i, doubt, 2 * SAFE)):
                doubt[i] = True
                continue
            tried[i] = True
            near = within(i, free, 1.0)
            n = np.where(rank[near] >= rank[i], cnt[near], 0)
            for j in np.flatnonzero(rank[near] < rank[i]):
                n[j] = sum(1 for k in late[near[j]] if k >= first[i])
            if n.sum() >= min_events:
                took = near[n > 0]
                free[took] = False
                seed[took] = first[i]
        pdf["tried"], pdf["seed"] = tried, seed
        return pdf[names]

    return run


def _replay_places(by: list[str], schema: T.StructType, radius_km: float, min_events: int, span: int):
    """The serial rule on the places of one tile, as far as it is sure there."""
    never = float("inf")
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(rows: pa.Table, places: pa.Table) -> pa.Table:
        places = places.combine_chunks()
        at = np.lexsort((places["lon"].to_numpy(), places["lat"].to_numpy()))
        places = places.take(pa.array(at))
        lat, lon = np.radians(places["lat"].to_numpy()), np.radians(places["lon"].to_numpy())
        inner, done, covers = places["inner"].to_pylist(), places["done"].to_pylist(), places["covers"].to_pylist()
        # one order of events and of the clusters known so far; a cluster stands right before the event that opened it
        pads = pc.utf8_slice_codeunits(pc.utf8_lpad(rows["name"], ID_CHARS, "0"), 0, ID_CHARS)
        facts = [(p, c) for p, of in enumerate(covers) for c in of]
        both = pa.table({
            "us": pa.chunked_array([*rows["us"].chunks, pa.array([c["us"] for _, c in facts], pa.int64())]),
            "pad": pa.chunked_array([*pads.chunks, pa.array([c["pad"] for _, c in facts], pads.type)]),
            "kind": pa.array(np.repeat([1, 0], [len(rows), len(facts)])),
        })
        turns = pc.sort_indices(both, [("us", "ascending"), ("pad", "ascending"), ("kind", "ascending")]).to_numpy()
        turn = np.empty(len(turns), np.int64)
        turn[turns] = np.arange(len(turns))
        row_lat, row_lon, us = rows["lat"].to_numpy(), rows["lon"].to_numpy(), rows["us"].to_numpy()
        held = [[] for _ in covers]  # (turn, time) of the clusters that reach a place
        for (p, c), t in zip(facts, turn[len(rows) :].tolist(), strict=True):
            held[p].append((t, c["us"]))
        for of in held:
            of.sort()
        turn = turn[: len(rows)]
        by_place = np.lexsort((turn, row_lon, row_lat))
        y, x = row_lat[by_place], row_lon[by_place]
        starts = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1])]).tolist()
        ends = [*starts[1:], len(by_place)]
        row, turn, us = by_place, turn[by_place].tolist(), us[by_place].tolist()
        # places beside the edge may lose events to clusters that are out of sight
        most = [-never if i else never for i in inner]
        every, near = np.ones(len(lat), bool), {}

        def reach(p: int) -> list[int]:
            if p not in near:
                near[p] = _near(lat, lon, p, every, radius_km).tolist()
            return near[p]

        def horizon(p: int, t: int) -> float:
            k = bisect_left(held[p], (t,))
            return held[p][k - 1][1] + span if k else -never

        def enough(p: int, e: int, surely: bool) -> bool:
            """Are there events enough from event e on, at the highest bound or at the lowest?"""
            n = 0
            for q in reach(p):
                past = horizon(q, turn[e])
                if surely:
                    past = max(past, most[q])
                lo, hi = starts[q], ends[q]
                lo = max(bisect_left(turn, turn[e], lo, hi), lo if past == -never else bisect_right(us, past, lo, hi))
                n += max(0, bisect_right(us, us[e] + span, lo, hi) - lo)
                if n >= min_events:
                    return True
            return False

        sure, new = [e - s for s, e in zip(starts, ends, strict=True)], [list(of) for of in covers]
        queue = [(turn[s + d], p, s + d) for p, (s, e, d) in enumerate(zip(starts, ends, done, strict=True)) if s + d < e]
        heapq.heapify(queue)
        while queue:
            t, p, e = heapq.heappop(queue)
            past = horizon(p, t)
            if us[e] <= past:
                e = bisect_right(us, past, e, ends[p])
            elif inner[p] and not enough(p, e, False):
                e += 1
            elif us[e] > most[p] and enough(p, e, True):
                for q in reach(p):
                    insort(held[q], (t, us[e]))
                    new[q].append({"us": us[e], "pad": pads[int(row[e])].as_py(), "id": rows["id"][int(row[e])].as_py()})
                e = bisect_right(us, us[e] + span, e, ends[p])
            else:  # in doubt until a known cluster reaches the place
                sure[p] = min(sure[p], e - starts[p])
                k = bisect_right(held[p], (t, never))
                until = held[p][k][1] + span if k < len(held[p]) else never
                for q in reach(p):
                    most[q] = max(most[q], until)
                e = ends[p] if until == never else bisect_right(us, until, e, ends[p])
            if e < ends[p]:
                heapq.heappush(queue, (turn[e], p, e))
        columns = {name: places[name] for name in schema.names}
        columns["done"] = pa.array(sure, pa.int32())
        columns["covers"] = pa.array(new, arrow.field("covers").type)
        return pa.table(columns).cast(arrow)

    return run

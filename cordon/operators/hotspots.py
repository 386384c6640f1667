"""Hotspots, their change over time, and route hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.geo import haversine
from cordon.functions.score import peak_band, severity_value
from cordon.operators.clusters import greedy_clusters
from cordon.operators.joins import alert_events, course_join, of_shape, radius_join, shapes  # noqa: F401
from cordon.operators.sizes import counts, mode_of, top_values
from cordon.refdata import fixed as V
from cordon.session import as_ts, cut


def describe(inc: DataFrame, members: DataFrame, radius_km: float) -> DataFrame:
    """One row per cluster from its members; every statistic is an aggregate with
    map-side combining, so a huge cluster stays cheap."""
    m = inc.join(members.select("id", "seed_id"), "id")
    base = m.groupBy("seed_id").agg(
        F.round(F.avg("latitude"), 4).alias("center_lat"), F.round(F.avg("longitude"), 4).alias("center_lon"),
        F.count(F.lit(1)).alias("event_count"), F.round(F.avg(severity_value()), 2).alias("severity_avg"),
        F.min("date_occurred").alias("first_event"), F.max("date_occurred").alias("last_event"),
        F.min_by("region", F.when(F.coalesce("region", F.lit("")) != "", F.struct("date_occurred", "id"))).alias("region"),
    )
    kind = mode_of(m, ["seed_id"], "event_type", "dominant_type")
    place = mode_of(m.withColumn("country_code", F.coalesce("country_code", F.lit("??"))), ["seed_id"], "country_code", "country_code")
    hour = mode_of(m.withColumn("_h", F.hour("date_occurred")), ["seed_id"], "_h", "_h").select("seed_id", peak_band("_h").alias("peak_hours"))
    tags = top_values(m.select("seed_id", F.explode("tags").alias("tag")), ["seed_id"], "tag", 3, "common_targets")
    out = base
    for part in (kind, place, hour, tags):
        out = out.join(part, "seed_id", "left")
    return (
        out.withColumn("radius_km", F.lit(float(radius_km)))
        .withColumn("region", F.coalesce("region", F.lit("")))
        .withColumn("trend", F.lit("STABLE"))
    )


def hotspots(inc: DataFrame, as_of, radius_km: float = 30.0, min_events: int = 3, days: int = 30) -> DataFrame:
    """Places with enough recent events within reach of the one that opens them."""
    recent = inc.where(F.col("date_occurred") >= as_ts(as_of) - F.expr(f"interval {days} days"))
    members = greedy_clusters(recent, "id", "date_occurred", radius_km=radius_km, min_events=min_events)
    return describe(recent, members, radius_km)


def location_clusters(inc: DataFrame, radius_km: float = 30.0, min_events: int = 3, days: int = 14) -> DataFrame:
    """As hotspots, but members must also be near the opening event in time."""
    members = greedy_clusters(inc, "id", "date_occurred", radius_km=radius_km, min_events=min_events, days=days)
    m = inc.join(members, "id")
    return m.groupBy("seed_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
        F.sort_array(F.collect_set("country_code")).alias("countries"),
    )


def hotspot_change(current: DataFrame, previous: DataFrame, km: float = 50.0) -> DataFrame:
    """Each current hotspot, largest first, takes the nearest previous one that is
    still free within reach. That serial choice equals repeated proposals: every
    unmatched hotspot asks its nearest candidate that has not refused it, and a
    candidate keeps the largest that asks. Hotspots of one run lie at least a
    radius apart, so their number is bounded by the map, not by the events."""
    cur = current.select(
        F.col("seed_id").alias("cur_id"), F.col("center_lat").alias("latitude"), F.col("center_lon").alias("longitude"), "event_count"
    )
    prev = previous.select(
        F.col("seed_id").alias("prev_id"), F.col("center_lat").alias("site_lat"), F.col("center_lon").alias("site_lon"),
        F.col("event_count").alias("prev_count"),
    )
    pairs = radius_join(cur, prev, km).where(F.col("km") < km).select("cur_id", "prev_id", "km", F.col("event_count").alias("size"))
    open_pairs = cut(pairs)
    while True:
        asks = open_pairs.groupBy("cur_id", "size").agg(F.min_by("prev_id", F.struct("km", "prev_id")).alias("prev_id"))
        kept = asks.groupBy("prev_id").agg(F.min_by("cur_id", F.struct(-F.col("size"), "cur_id")).alias("winner"))
        refused = asks.join(kept, "prev_id").where(F.col("cur_id") != F.col("winner")).select("cur_id", "prev_id")
        left = cut(open_pairs.join(refused, ["cur_id", "prev_id"], "left_anti"))
        if left.count() == open_pairs.count():
            break
        open_pairs = left
    match = asks.select("cur_id", "prev_id")
    n, p = F.col("event_count"), F.col("prev_event_count")
    status = (
        F.when(p.isNull(), "EMERGING").when(n > p * 1.3, "GROWING").when(n < p * 0.7, "FADING").otherwise("STABLE")
    )
    cols = ["center_lat", "center_lon", "country_code", "region", "dominant_type"]
    now = (
        current.withColumnRenamed("seed_id", "cur_id").join(match, "cur_id", "left")
        .join(previous.select(F.col("seed_id").alias("prev_id"), F.col("event_count").alias("prev_event_count")), "prev_id", "left")
        .select(status.alias("status"), *cols, "event_count", "prev_event_count")
    )
    gone = previous.withColumnRenamed("seed_id", "prev_id").join(match, "prev_id", "left_anti").select(
        F.lit("RESOLVED").alias("status"), *cols, F.lit(0).cast("bigint").alias("event_count"), F.col("event_count").alias("prev_event_count")
    )
    return now.unionByName(gone)


def hotspot_geojson(h: DataFrame) -> DataFrame:
    """One GeoJSON feature per row as text; a writer wraps the parts."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    props = F.struct(
        "event_count", "severity_avg", "dominant_type", "country_code", "region", "radius_km", "peak_hours", "common_targets", "trend",
        F.date_format("first_event", iso).alias("first_event"), F.date_format("last_event", iso).alias("last_event"),
    )
    geometry = F.struct(F.lit("Point").alias("type"), F.array("center_lon", "center_lat").alias("coordinates"))
    return h.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties"))).alias("value"))


# --- route report ------------------------------------------------------------

def route_hotspots(inc: DataFrame, stored: DataFrame, routes: DataFrame, as_of, buffer_km: float = 50.0) -> DataFrame:
    """Clusters (any size, 25 km) of the last 90 days' thefts in each route's
    buffer, and the stored hotspots in it."""
    return of_shape(_course_hotspots(inc, stored, routes, as_of, buffer_km), routes)


def _course_hotspots(inc: DataFrame, stored: DataFrame, routes: DataFrame, as_of, buffer_km: float) -> DataFrame:
    recent = inc.where(F.col("event_type").isin(V.THEFT_TYPES) & (F.col("date_occurred") >= as_ts(as_of) - F.expr("interval 90 days")))
    hit = course_join(recent, routes, buffer_km).select("route_id", "id", "date_occurred", "latitude", "longitude", "event_type")
    members = greedy_clusters(hit, "id", "date_occurred", radius_km=25.0, min_events=1, by=["route_id"])
    found = hit.join(members, ["route_id", "id"]).groupBy("route_id", "seed_id").agg(
        F.round(F.avg("latitude"), 4).alias("latitude"), F.round(F.avg("longitude"), 4).alias("longitude"),
        F.count(F.lit(1)).alias("event_count"), F.sort_array(F.collect_set("event_type")).alias("event_types"),
    )
    found = found.select(
        "route_id", "latitude", "longitude", "event_count", "event_types",
        F.when(F.col("event_count") >= 3, "high").otherwise("medium").alias("severity"), F.lit(25.0).alias("radius_km"),
    )
    known = course_join(stored, routes, buffer_km).select(
        "route_id", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"), "event_count",
        F.array("hotspot_type").alias("event_types"), "severity", "radius_km",
    )
    return found.unionByName(known)


def route_report(inc, stored, road_alerts, routes, as_of, buffer_km: float = 50.0) -> DataFrame:
    """One row per route: length, counts and advice. Routes of the same course are worked out once."""
    every, routes = routes, shapes(routes)
    spots = counts(_course_hotspots(inc, stored, routes, as_of, buffer_km), ["route_id"], "hotspots")
    recent = inc.where(F.col("event_type").isin(V.THEFT_TYPES) & (F.col("date_occurred") >= as_ts(as_of) - F.expr("interval 90 days")))
    events = counts(course_join(recent.select("id", "latitude", "longitude"), routes, buffer_km), ["route_id"], "events_90d")
    ra = road_alerts.withColumn("_at", F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz"))
    ra = ra.where(F.col("_at") >= as_ts(as_of) - F.expr("interval 48 hours"))
    placed = counts(course_join(ra.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")), routes, buffer_km), ["route_id"], "placed")
    unplaced = ra.where(F.col("lat").isNull() | F.col("lon").isNull()).agg(F.count(F.lit(1)).alias("unplaced")).withColumn("_k", F.lit(1))
    out = routes.withColumn("_k", F.lit(1)).join(unplaced, "_k").drop("_k")
    for part in (spots, events, placed):
        out = out.join(part, "route_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(
        "route_id", F.round(haversine("from_lat", "from_lon", "to_lat", "to_lon"), 1).alias("distance_km"),
        zero("hotspots").alias("hotspots"), zero("events_90d").alias("events_90d"), (zero("placed") + zero("unplaced")).alias("road_alerts"),
    )
    advice = F.array_compact(
        F.array(
            F.when(F.col("hotspots") > 0, "avoid_overnight_stops"), F.when(F.col("events_90d") >= 5, "enhance_security"),
            F.when(F.col("road_alerts") > 0, "check_delays"),
        )
    )
    out = of_shape(out, every)
    return out.withColumn("advice", F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("standard_precautions"))))

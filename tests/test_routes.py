"""Points in the buffers of routes, however many share a course."""

from pyspark.sql import functions as F

from cordon.operators import hotspots, joins

COLS = "route_id long, from_lat double, from_lon double, to_lat double, to_lon double"


def test_each_point_with_every_route_of_a_course(spark, monkeypatch):
    """One course of 30 routes, one of a single route, one far off; two events at one place, one without a place."""
    courses = {0: (50.0, 10.0, 52.0, 13.0), 1: (50.0, 10.0, 50.0, 14.0), 2: (60.0, 20.0, 61.0, 21.0)}
    routes = spark.createDataFrame([(k, *courses[0 if k < 30 else k - 29]) for k in range(32)], COLS)
    points = spark.createDataFrame([(1, 50.01, 10.0, "a"), (2, 50.01, 10.0, "b"), (3, 52.0, 13.0, "a"), (4, 50.0, 13.9, "c"), (5, None, 13.9, "c"), (6, 0.0, 0.0, "c")], "id long, latitude double, longitude double, kind string")
    far = [(k, i) for k in range(30) for i in (1, 2, 3)] + [(30, 1), (30, 2), (30, 4)]
    for name, n in (("PAIRS", 50_000_000), ("PAIRS", 7), ("IDS", 5), ("RUN", 2), ("SOME", 1)):
        monkeypatch.setattr(joins, name, n, raising=False)
        got = joins.route_join(points, routes, 30.0).collect()
        assert sorted((r.route_id, r.id) for r in got) == sorted(far)
        assert {r.id: r.kind for r in got} == {1: "a", 2: "b", 3: "a", 4: "c"} and all(0 <= r.km <= 30 for r in got)
    assert joins.route_join(points.limit(0), routes, 30.0).count() == joins.route_join(points, routes.limit(0), 30.0).count() == 0
    assert sorted((r.route_id, r.id) for r in joins.course_join(points, routes, 30.0).collect()) == [(0, 1), (0, 2), (0, 3), (30, 1), (30, 2), (30, 4)]


def test_hotspots_of_every_route_of_a_course(spark):
    routes = spark.createDataFrame([(k, 50.0, 10.0, 52.0, 13.0) for k in (3, 8, 9)], COLS)
    inc = spark.createDataFrame([(1, "theft_cargo", 50.01, 10.0)], "id long, event_type string, latitude double, longitude double").withColumn("date_occurred", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    stored = spark.createDataFrame([(52.0, 13.0, 5, "theft_cargo", "low", 25.0)], "latitude double, longitude double, event_count long, hotspot_type string, severity string, radius_km double")
    got = hotspots.route_hotspots(inc, stored, routes, "2024-01-31 00:00:00").collect()
    assert sorted((r.route_id, r.event_count) for r in got) == [(k, n) for k in (3, 8, 9) for n in (1, 5)]


def test_points_of_many_routes_take_few_bytes_when_stored(spark, tmp_path):
    """9,001 routes of one course, 200 points: all routes of a point in a row would take some two bytes a pair."""
    routes = spark.range(9_001).selectExpr("id * 3 as route_id", "50.0D as from_lat", "10.0D as from_lon", "52.0D as to_lat", "13.0D as to_lon")
    points = spark.range(200).selectExpr("id * 7 as id", "50.0D + id / 100000 as latitude", "10.0D as longitude")
    joins.route_join(points, routes, 30.0).select("route_id", "id", F.round("km", 3).alias("km")).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    assert pairs.select("route_id", "id").distinct().count() == pairs.count() == 1_800_200
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.5 * 1_800_200

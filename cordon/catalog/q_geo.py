"""Distances, spatial joins, names in texts, corridors, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cordon.catalog import bind as B
from cordon.catalog.oracle import arr, hav, half, seg, values
from cordon.catalog.registry import query
from cordon.functions.geo import haversine, segment_km
from cordon.operators import correlate as c
from cordon.operators import enrich as e
from cordon.operators import hotspots as h
from cordon.operators import joins as j
from cordon.refdata import fixed as V

THEFT = str(V.THEFT_TYPES)[1:-1]


@query("haversine", "G1", f"SELECT id, round({hav('latitude', 'longitude', '52.2297', '21.0122')}, 6) AS km FROM incident")
def _(spark, sf):
    return B.incidents(spark, sf).select("id", F.round(haversine("latitude", "longitude", 52.2297, 21.0122), 6).alias("km"))


@query("segment_distance", "G2", f"SELECT id, round({seg('latitude', 'longitude', '48.0::DOUBLE', '2.0::DOUBLE', '52.0::DOUBLE', '21.0::DOUBLE')}, 6) AS km FROM incident")
def _(spark, sf):
    return B.incidents(spark, sf).select("id", F.round(segment_km("latitude", "longitude", 48.0, 2.0, 52.0, 21.0), 6).alias("km"))


@query("geocode", "G4", f"""SELECT i.id, i.city, g.lat AS geo_lat, g.lon AS geo_lon FROM incident i LEFT JOIN ({values([(key.lower(), lat, lon) for name, _, lat, lon, _, more in V.CITIES for key in [name, *more]], "key, lat, lon")}) g ON lower(trim(i.city)) = g.key""")
def _(spark, sf):
    return e.geocode(B.incidents(spark, sf).select("id", "city"), "city", e.gazetteer(spark))


@query("highways_in_text", "G5", f"""WITH t AS (SELECT id, regexp_extract_all(description, '\\b([ABEMDNS]\\d{{1,3}})\\b', 1) AS l FROM incident), u AS (SELECT id, unnest(l) AS code, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM t)
  SELECT u.id, u.pos, u.code, coalesce({arr('hw.countries')}, '') AS countries FROM u LEFT JOIN highway hw ON hw.code = u.code""")
def _(spark, sf):
    return e.highways(B.incidents(spark, sf), "id", F.col("description"), e.highway_ref(spark))


@query("best_corridor", "G6", """WITH s AS (SELECT i.id, m.corridor, m.rnk, max(CASE WHEN m.cc = i.country_code THEN 1 ELSE 0 END) + max(CASE WHEN list_contains(m.roads, i.road) THEN 3 ELSE 0 END) AS s FROM incident i CROSS JOIN corridor_member m GROUP BY 1, 2, 3)
  SELECT id, corridor FROM s WHERE s >= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, rnk) = 1""")
def _(spark, sf):
    return j.best_corridor(B.incidents(spark, sf), "id", F.array("country_code"), F.col("road"), j.corridor_members(spark))


@query("nearby_parking", "G7", f"SELECT i.id, p.park, {half(hav('i.latitude', 'i.longitude', 'p.lat', 'p.lon'), 1)} AS distance_km FROM incident i JOIN park p ON {hav('i.latitude', 'i.longitude', 'p.lat', 'p.lon')} <= 60")
def _(spark, sf):
    return j.nearby_parking(B.incidents(spark, sf), j.truck_parks(spark), 60.0).select("id", "park", "distance_km")


@query("border_area", "G8", f"""SELECT i.id, b.border, b.ccs AS border_countries, {half(hav('i.latitude', 'i.longitude', 'b.lat', 'b.lon'), 1)} AS distance_km FROM incident i JOIN border_crossing b ON {hav('i.latitude', 'i.longitude', 'b.lat', 'b.lon')} <= 80
  QUALIFY row_number() OVER (PARTITION BY i.id ORDER BY b.rnk) = 1""")
def _(spark, sf):
    return j.border_area(B.incidents(spark, sf), j.borders(spark), 80.0)


RD = hav("lat", "lon", "48.0::DOUBLE", "10.0::DOUBLE")


@query("road_alerts_within", "G9", f"SELECT id, CASE WHEN lat IS NOT NULL THEN {half(RD, 1)} END AS distance_km FROM road_alert WHERE lat IS NULL OR {RD} <= 400")
def _(spark, sf):
    return j.within(B.road_alerts(spark, sf), 48.0, 10.0, 400.0).select("id", "distance_km")


RS = seg("lat", "lon", "44.0::DOUBLE", "0.0::DOUBLE", "52.0::DOUBLE", "20.0::DOUBLE")


@query("road_alerts_along_route", "G10", f"SELECT id, CASE WHEN lat IS NOT NULL THEN {half(RS, 1)} END AS distance_km FROM road_alert WHERE lat IS NULL OR {RS} <= 120")
def _(spark, sf):
    return j.along_route(B.road_alerts(spark, sf), (44.0, 0.0), (52.0, 20.0), 120.0).select("id", "distance_km")


@query("name_mentions", "J2", """SELECT incident_id, company_id, bool_or(by_name) AS by_name, bool_or(by_link) AS by_link FROM (
  SELECT i.id AS incident_id, c.id AS company_id, true AS by_name, false AS by_link FROM incident i JOIN company c ON contains(lower(i.title), lower(c.name)) OR contains(lower(i.description), lower(c.name))
  UNION ALL SELECT id, company_id, false, true FROM incident WHERE company_id IS NOT NULL) GROUP BY 1, 2""")
def _(spark, sf):
    return j.mentions(B.incidents(spark, sf), B.companies(spark, sf))


@query("text_contains_names", "J2", """SELECT d.doc_id, b.item_id FROM documents d JOIN (SELECT item_id, lower(text) AS t FROM benchmark) b ON contains(lower(d.text), b.t)""")
def _(spark, sf):
    names = B.table(spark, sf, "benchmark").selectExpr("item_id", "text as t")
    return j.contained(B.table(spark, sf, "documents"), "doc_id", "text", names, "item_id", "t")


@query("resolve_company", "J3", """WITH m AS (SELECT r.req_id, c.id, c.name, c.country_code AS cc, r.country_code AS rc FROM request r JOIN company c ON contains(lower(c.name), lower(r.name))),
  b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY (cc = rc) DESC, length(name), id) = 1)
  SELECT r.req_id, CAST(b.id AS VARCHAR) AS company_id, b.name AS company_name, b.cc AS company_country FROM request r LEFT JOIN b ON b.req_id = r.req_id""")
def _(spark, sf):
    return j.resolve_company(B.requests(spark, sf), B.companies(spark, sf)).select("req_id", F.col("company_id").cast("string").alias("company_id"), "company_name", "company_country")


@query("corridor_events", "J7", "SELECT i.id, s.corridor FROM incident i JOIN corridor_segment s ON i.country_code = s.cc AND i.road = s.road")
def _(spark, sf):
    return j.corridor_events(B.incidents(spark, sf), j.segments(spark)).select("id", "corridor")


@query("corridor_events_loose", "J8", "SELECT i.id, m.corridor FROM incident i JOIN corridor_member m ON i.country_code = m.cc AND (i.road IS NULL OR list_contains(m.roads, i.road))")
def _(spark, sf):
    return j.corridor_events2(B.incidents(spark, sf), j.corridor_members(spark)).select("id", "corridor")


@query("near_sites", "J9", f"""SELECT i.id, h.region AS site, {half(hav('i.latitude', 'i.longitude', 'h.latitude', 'h.longitude'), 3)} AS km FROM incident i JOIN hotspot h ON {hav('i.latitude', 'i.longitude', 'h.latitude', 'h.longitude')} <= 120""")
def _(spark, sf):
    sites = B.stored_hotspots(spark, sf).selectExpr("region as site", "latitude as site_lat", "longitude as site_lon")
    return j.radius_join(B.incidents(spark, sf).select("id", "latitude", "longitude"), sites, 120.0).select("id", "site", F.round("km", 3).alias("km"))


@query("region_match", "J10", """SELECT r.req_id, i.id FROM incident i JOIN region_request r ON i.country_code = r.country_code AND (i.region IS NULL OR contains(lower(i.region), lower(r.region)) OR contains(lower(r.region), lower(i.region)))""")
def _(spark, sf):
    return j.region_match(B.incidents(spark, sf), B.region_requests(spark, sf))


RT = seg("i.latitude", "i.longitude", "r.from_lat", "r.from_lon", "r.to_lat", "r.to_lon")


@query("route_buffer", "C8,G10", f"SELECT r.route_id, i.id, round({RT}, 3) AS km FROM incident i JOIN route r ON {RT} <= 80")
def _(spark, sf):
    return j.route_join(B.incidents(spark, sf).select("id", "latitude", "longitude"), B.routes(spark, sf), 80.0).select("route_id", "id", F.round("km", 3).alias("km"))


@query("route_report", "C8", None)
def _(spark, sf):
    return h.route_report(B.incidents(spark, sf), B.stored_hotspots(spark, sf), B.road_alerts(spark, sf), B.routes(spark, sf), B.AS_OF, 80.0)


# The greedy rule in order of (date, id), o: a spot has its first event's turn; it is decided once no earlier spot within
# twice the radius is open, and, if its untaken events from then on within the radius are three, takes all of them.
NEAR = hav("a.lat", "a.lon", "b.lat", "b.lon")
GREEDY = f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date_occurred, id) AS o FROM incident WHERE date_occurred >= TIMESTAMP '2024-01-01 00:00:00' AND latitude IS NOT NULL AND longitude IS NOT NULL),
  spot AS MATERIALIZED (SELECT latitude AS lat, longitude AS lon, min(o) AS sid, count(*) AS cnt, CASE WHEN count(*) < 3 THEN list(o) END AS late FROM ev GROUP BY 1, 2),
  cell AS (SELECT sid, lat, lon, CAST(floor(lat / 0.6) AS INTEGER) AS cy FROM spot),
  pair AS MATERIALIZED (SELECT a.sid AS a, b.sid AS b, {NEAR} <= 30 AS reach FROM cell a JOIN (SELECT sid, lat, lon, cy + unnest([-1, 0, 1]) AS cy FROM cell) b ON a.cy = b.cy AND {NEAR} <= 60.001),
  w AS (SELECT sid, false AS tried, NULL::BIGINT AS seed, 0 AS step FROM spot UNION ALL
    SELECT w.sid, w.tried OR d.a IS NOT NULL, coalesce(w.seed, t.seed), w.step + 1
    FROM w LEFT JOIN (SELECT sid AS a FROM w WHERE NOT tried AND seed IS NULL AND sid NOT IN (SELECT p.a FROM pair p JOIN w x ON x.sid = p.b JOIN w y ON y.sid = p.a WHERE p.b < p.a AND NOT x.tried AND x.seed IS NULL AND NOT y.tried AND y.seed IS NULL)) d ON d.a = w.sid
    LEFT JOIN (SELECT b, a AS seed FROM (SELECT p.a, p.b, n, sum(n) OVER (PARTITION BY p.a) AS total FROM
        (SELECT p.a, p.b, CASE WHEN p.b >= p.a THEN s.cnt ELSE len(list_filter(s.late, lambda k: k >= p.a)) END AS n FROM pair p JOIN spot s ON s.sid = p.b JOIN w f ON f.sid = p.b JOIN w y ON y.sid = p.a
          WHERE p.reach AND f.seed IS NULL AND NOT y.tried AND y.seed IS NULL AND p.a NOT IN (SELECT q.a FROM pair q JOIN w x ON x.sid = q.b WHERE q.b < q.a AND NOT x.tried AND x.seed IS NULL)) p) WHERE total >= 3 AND n > 0) t ON t.b = w.sid
    WHERE EXISTS (SELECT 1 FROM w WHERE NOT tried AND seed IS NULL)),
  m AS MATERIALIZED (SELECT ev.*, first.id AS seed_id FROM ev JOIN spot ON spot.lat = ev.latitude AND spot.lon = ev.longitude JOIN (SELECT sid, seed FROM w WHERE step = (SELECT max(step) FROM w)) z ON z.sid = spot.sid JOIN ev first ON first.o = z.seed WHERE ev.o >= z.seed)"""


@query("hotspots", "C1", f"""{GREEDY}, k AS (SELECT seed_id, event_type AS v FROM (SELECT seed_id, event_type, row_number() OVER (PARTITION BY seed_id ORDER BY count(*) DESC, event_type) AS rn FROM m GROUP BY 1, 2) WHERE rn = 1),
  cc AS (SELECT seed_id, country AS v FROM (SELECT seed_id, coalesce(country_code, '??') AS country, row_number() OVER (PARTITION BY seed_id ORDER BY count(*) DESC, coalesce(country_code, '??')) AS rn FROM m GROUP BY 1, 2) WHERE rn = 1),
  hh AS (SELECT seed_id, hour AS v FROM (SELECT seed_id, hour(date_occurred) AS hour, row_number() OVER (PARTITION BY seed_id ORDER BY count(*) DESC, hour(date_occurred)) AS rn FROM m GROUP BY 1, 2) WHERE rn = 1),
  tg AS (SELECT seed_id, string_agg(tag, ',' ORDER BY rn) AS v FROM (SELECT seed_id, tag, row_number() OVER (PARTITION BY seed_id ORDER BY count(*) DESC, tag) AS rn FROM (SELECT seed_id, unnest(tags) AS tag FROM m) GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1)
  SELECT m.seed_id, count(*) AS event_count, any_value(k.v) AS dominant_type, any_value(cc.v) AS country_code, any_value(tg.v) AS common_targets,
  any_value(CASE WHEN hh.v >= 22 OR hh.v < 5 THEN '22:00-05:00 (night)' WHEN hh.v < 10 THEN '06:00-10:00 (morning)' WHEN hh.v < 16 THEN '10:00-16:00 (daytime)' ELSE '16:00-22:00 (evening)' END) AS peak_hours
  FROM m JOIN k ON k.seed_id = m.seed_id JOIN cc ON cc.seed_id = m.seed_id JOIN hh ON hh.seed_id = m.seed_id LEFT JOIN tg ON tg.seed_id = m.seed_id GROUP BY 1""")
def _(spark, sf):
    return h.hotspots(B.incidents(spark, sf), B.AS_OF).select("seed_id", "event_count", "dominant_type", "country_code", "common_targets", "peak_hours")


@query("location_clusters", "C2", None)
def _(spark, sf):
    return h.location_clusters(B.incidents(spark, sf))


@query("hotspot_change", "C3,J13", None)
def _(spark, sf):
    i = B.incidents(spark, sf)
    cur = h.hotspots(i.where("date_occurred >= timestamp_ntz'2024-01-16'"), B.AS_OF, 30.0, 2, 90)
    prev = h.hotspots(i.where("date_occurred < timestamp_ntz'2024-01-16' and event_type <> 'strike'"), B.AS_OF, 30.0, 2, 90)
    return h.hotspot_change(cur, prev)


@query("hotspots_geojson", "S18", None)
def _(spark, sf):
    return h.hotspot_geojson(h.hotspots(B.incidents(spark, sf), B.AS_OF))


@query("correlate", "C4", None)
def _(spark, sf):
    return c.correlate(B.incidents(spark, sf), j.segments(spark))


BONUS = "CASE WHEN count(*) >= 10 THEN 0.35 WHEN count(*) >= 5 THEN 0.25 WHEN count(*) >= 3 THEN 0.15 ELSE 0.05 END"
FINO, OPER = str(c.FINANCIAL)[1:-1], str(c.OPERATIONAL)[1:-1]


@query("financial_operational_companies", "C5,C7", f"""SELECT lower(company_name) AS company, count(*) AS event_count, count(*) FILTER (event_type IN ({FINO})) AS financial_events, count(*) FILTER (event_type IN ({OPER})) AS operational_events,
  string_agg(DISTINCT country_code, ',' ORDER BY country_code) AS countries, round(0.5 + {BONUS}, 2)::DOUBLE AS confidence FROM incident GROUP BY 1 HAVING count(*) FILTER (event_type IN ({FINO})) > 0 AND count(*) FILTER (event_type IN ({OPER})) > 0 AND count(*) >= 2""")
def _(spark, sf):
    return c.fin_op_companies(B.incidents(spark, sf))


@query("cross_country_routes", "C6,C7", f"""SELECT corridor, count(*) AS event_count, string_agg(DISTINCT i.country_code, ',' ORDER BY i.country_code) AS countries, string_agg(DISTINCT i.road, ',' ORDER BY i.road) AS roads,
  least(1.0, round(0.4 + {BONUS} + least(0.15, count(DISTINCT i.country_code) * 0.05), 2))::DOUBLE AS confidence FROM incident i JOIN corridor_segment s ON i.country_code = s.cc AND i.road = s.road GROUP BY 1 HAVING count(DISTINCT i.country_code) >= 2""")
def _(spark, sf):
    return c.cross_country(B.incidents(spark, sf), j.segments(spark))

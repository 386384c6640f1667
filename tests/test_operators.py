"""Joins, windows, clusters and gates against brute force and edge cases."""

import datetime as dt
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cordon.operators import alerts as al
from cordon.operators import clusters, gates, joins, sizes, stats, windows
from cordon.plans import ingest as ing
from cordon.sources import ingest_rows as ir
from cordon.sources import pages, road_alerts
from cordon.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def greedy(rows, r, n, days=None):
    rows, used, out = sorted(rows, key=lambda x: (x[1], x[0])), set(), {}
    for i, (a, t, la, lo) in enumerate(rows):
        if i in used:
            continue
        cl = [i] + [j for j in range(i + 1, len(rows)) if j not in used and km(la, lo, *rows[j][2:]) <= r and (days is None or abs((t - rows[j][1]).days) <= days)]
        if len(cl) >= n:
            for x in cl:
                used.add(x)
                out[rows[x][0]] = a
    return out


def clustered(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, latitude double, longitude double")
    return {r.id: r.seed_id for r in clusters.greedy_clusters(df, "id", "ts", **kw).collect()}


def test_clusters_match_the_serial_rule(spark):
    rnd = random.Random(7)
    spots = [(50 + rnd.random() * 0.9, 10 + rnd.random() * 0.9) for _ in range(18)]
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randrange(40 * 86400)), *rnd.choice(spots)) for i in range(50)]
    assert clustered(spark, rows, radius_km=30, min_events=3) == greedy(rows, 30, 3)
    wide = [(i, T0 + dt.timedelta(seconds=rnd.randrange(60 * 86400)), 50 + rnd.random() * 2, 10 + rnd.random() * 2) for i in range(400)]
    for n, days in ((1, None), (4, None), (3, 14)):
        assert clustered(spark, wide, radius_km=30, min_events=n, days=days) == greedy(wide, 30, n, days)


def test_clusters_across_tiles(spark):
    """Two thousand chained points over many tiles, with and without days and groups; the date line and a pole."""
    rnd = random.Random(11)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randrange(90 * 86400)), 44 + rnd.random() * 8, 4 + rnd.random() * 12) for i in range(2000)]
    for n, days in ((3, None), (2, 5)):
        assert clustered(spark, rows, radius_km=30, min_events=n, days=days) == greedy(rows, 30, n, days)
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "id long, ts timestamp_ntz, latitude double, longitude double, g int")
    got = {(r.g, r.id): r.seed_id for r in clusters.greedy_clusters(df, "id", "ts", radius_km=40, by=["g"]).collect()}
    assert got == {(g, k): v for g in range(3) for k, v in greedy([r for r in rows if r[0] % 3 == g], 40, 3).items()}
    odd = [(i, T0 + dt.timedelta(seconds=rnd.randrange(86400)), rnd.choice([-0.3, 0.0, 0.4, 89.9, 89.5]), rnd.choice([-179.9, 179.9, 179.6, -179.5, 0.0, 90.0])) for i in range(60)]
    assert clustered(spark, odd, radius_km=30, min_events=2) == greedy(odd, 30, 2)
    assert clustered(spark, [], radius_km=30) == {}


def test_clusters_in_split_tiles(spark, monkeypatch):
    """Full wide tiles beside empty ones, dealt as narrow tiles; reaches so large that a row has few columns."""
    monkeypatch.setattr(clusters, "LOAD", 40)
    rnd = random.Random(12)
    near = [(i, T0 + dt.timedelta(seconds=rnd.randrange(90 * 86400)), 44 + rnd.random() * 5, 4 + rnd.random() * 9) for i in range(500)]
    far = [(2000 + i, T0 + dt.timedelta(days=i % 50), -30 + rnd.random() * 60, -180 + rnd.random() * 360) for i in range(60)]
    assert clustered(spark, near + far, radius_km=30, min_events=2, days=20) == greedy(near + far, 30, 2, 20)
    globe = [(i, T0 + dt.timedelta(minutes=i), -89 + rnd.random() * 178, -180 + rnd.random() * 360) for i in range(80)]
    assert clustered(spark, globe, radius_km=400, min_events=2) == greedy(globe, 400, 2)


def test_cluster_time_edge_and_chain(spark):
    day = dt.timedelta(days=1)
    chain = [(1, T0, 50.0, 10.0), (2, T0 + day, 50.2, 10.0), (3, T0 + 2 * day, 50.4, 10.0), (4, T0 + 3 * day, 50.0, 10.0)]
    assert clustered(spark, chain, radius_km=30, min_events=3) == greedy(chain, 30, 3) == {1: 1, 2: 1, 4: 1}
    edge = [(1, T0, 50.0, 10.0), (2, T0 + 14 * day, 50.0, 10.0), (3, T0 + 14 * day + dt.timedelta(seconds=1), 50.0, 10.0)]
    assert clustered(spark, edge, radius_km=30, min_events=2, days=14) == greedy(edge, 30, 2, 14) == {1: 1, 2: 1}


def test_busy_places_take_no_step_an_event(spark, monkeypatch):
    """Three places with thousands of events: distances are taken once a place, and the clusters are those of the serial rule."""
    rnd, asked, near = random.Random(13), [], clusters._near
    monkeypatch.setattr(clusters, "_near", lambda *a: asked.append(1) or near(*a))
    spots = [(50.0, 10.0), (50.1, 10.0), (50.3, 10.0)]
    rows = [(i, T0 + dt.timedelta(seconds=k), *rnd.choice(spots)) for i, k in enumerate(rnd.sample(range(60 * 86400), 4000))]
    seen = pa.table({"us": [int((r[1] - T0).total_seconds()) * 10**6 for r in rows], "id": [r[0] for r in rows], "name": [str(r[0]) for r in rows], "lat": [r[2] for r in rows], "lon": [r[3] for r in rows]})
    cover = T.StructType.fromDDL("us long, pad string, id long")
    schema = T.StructType.fromDDL("lat double, lon double, n int, done int").add("covers", T.ArrayType(cover))
    n = [sum(r[2:] == s for r in rows) for s in spots]
    places = pa.table({"lat": [s[0] for s in spots], "lon": [s[1] for s in spots], "n": n, "done": [0] * 3, "inner": [True] * 3, "covers": pa.array([[]] * 3, pa.list_(pa.struct([("us", pa.int64()), ("pad", pa.string()), ("id", pa.int64())])))})
    out = clusters._replay_places([], schema, 30.0, 3, 14 * clusters.DAY_US)(seen, places)
    assert out["done"].to_pylist() == n and len(asked) <= len(spots)
    assert {c["id"] for of in out["covers"].to_pylist() for c in of} == set(greedy(rows, 30, 3, 14).values())


def test_contained_equals_nested_loop(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcAB ") for _ in range(n))
    texts = [(i, word(rnd.randrange(0, 60))) for i in range(80)] + [(99, "xxTransEuropa GmbHyy\nline")]
    names = [(i, word(rnd.randrange(1, 12)).strip() or "a") for i in range(40)] + [(77, "transeuropa gmbh")]
    a, b = spark.createDataFrame(texts, "t long, text string"), spark.createDataFrame(names, "n long, name string")
    want = {(t, n) for t, x in texts for n, y in names if y.lower() in x.lower()}
    for rows in (1000, 0):  # broadcast path, shuffled path
        got = [(r.t, r.n) for r in joins.contained(a, "t", "text", b, "n", "name", broadcast_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fan_out_equals_nested_loop(spark):
    """Countries in common, empty and null lists on either side, repeated countries, the index's own marks as codes."""
    rnd = random.Random(8)
    lists = [None, [], ["PL"], ["PL", "PL", "DE"], ["DE", "FR"], ["FR"], ["XX", "PL"]]
    items, subs = [(i, rnd.choice(lists)) for i in range(40)], [(100 + i, rnd.choice(lists), True) for i in range(40)]
    got = joins.fan_out_reports(spark.createDataFrame(items, "id long, countries array<string>"), spark.createDataFrame(subs, "id long, subscribed_countries array<string>, is_active boolean"))
    pairs = [(r.report_id, r.subscriber_id) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, j) for i, a in items for j, b, _ in subs if not a or not b or set(a) & set(b)}


def test_radius_join_equals_nested_loop(spark):
    rnd = random.Random(5)
    pts = [(i, 36 + rnd.random() * 34, -9 + rnd.random() * 40) for i in range(400)]
    sites = [(i, 36 + rnd.random() * 34, -9 + rnd.random() * 40) for i in range(60)]
    got = joins.radius_join(spark.createDataFrame(pts, "id int, latitude double, longitude double"), spark.createDataFrame(sites, "s int, site_lat double, site_lon double"), 150.0)
    assert {(r.id, r.s) for r in got.collect()} == {(p, s) for p, a, b in pts for s, c, d in sites if km(a, b, c, d) <= 150}


def test_company_burst_edges(spark):
    day = dt.timedelta(days=1)
    rows = [(1, "a", T0), (2, "a", T0 + 10 * day), (3, "a", T0 + 31 * day - dt.timedelta(hours=1)),  # 30 d 23 h: in
            (4, "b", T0), (5, "b", T0 + 10 * day), (6, "b", T0 + 31 * day),  # 31 d: out
            (7, "c", T0), (8, "c", None), (9, "c", T0 + day)]
    df = spark.createDataFrame([(i, c, t, "PL") for i, c, t in rows], "id long, company_id string, date_occurred timestamp_ntz, country_code string")
    got = windows.company_bursts(df).collect()
    assert [(r.company_id, r.first_id, r.event_count) for r in got] == [("a", 1, 3)]


def test_burst_counts_hot_company(spark):
    rows = [(i, "hot", T0 + dt.timedelta(seconds=i), "PL") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, company_id string, date_occurred timestamp_ntz, country_code string")
    r = windows.company_bursts(df).first()
    assert (r.first_id, r.event_count) == (0, 500)


def test_week_numbers(spark):
    days = ["2023-12-31", "2024-01-01", "2023-01-01", "2023-01-02"]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("t", F.col("d").cast("timestamp_ntz"))
    got = {r.d: r.w for r in df.select("d", stats.monday_week("t").alias("w")).collect()}
    assert got == {d: dt.date.fromisoformat(d).strftime("%Y-W%W") for d in days}


INC = "id long, country_code string, region string, severity string, title string, date_collected timestamp_ntz"
ALERT = "alert_type string, is_active boolean, country_codes array<string>, triggered_at timestamp_ntz, related_event_ids array<long>"


def test_spike_rules(spark):
    now = T0 + dt.timedelta(hours=1)
    at = lambda m: now - dt.timedelta(minutes=m)
    inc = spark.createDataFrame(
        [(1, "PL", "A", "low", "x", at(5)), (2, "PL", "A", "low", "x", at(6)), (3, "PL", "A", "low", "x", at(7)), (4, "DE", "B", "low", "x", at(5)), (5, "DE", "B", "low", "x", at(5)),
         (6, "FR", None, "low", "x", at(1)), (7, "FR", None, "low", "x", at(1)), (8, "FR", None, "critical", "x", at(1)), (9, "NL", "C", "low", "x", at(31))], INC)
    none = spark.createDataFrame([], ALERT)
    got = al.spike_alerts(inc, none, now).collect()
    assert [(r.country_codes, r.related_event_ids) for r in got] == [(["PL"], [1, 2, 3])]  # DE has two; FR has its critical alert
    assert [r.related_event_ids for r in al.critical_alerts(inc, none, now).collect()] == [[8]]
    have = spark.createDataFrame([("theft_spike", True, ["PL"], at(10), [77])], ALERT)
    assert al.spike_alerts(inc, have, now).count() == 0


def test_gate_partitions_its_input(spark):
    rows = [("u1", "clean", "news", False), ("u2", "mail a@b.pl", "forum", False), ("u3", "mail a@b.pl", "police", True), ("u4", "mail a@b.pl", "news", False), (None, "x", "news", False)]
    df = spark.createDataFrame(rows, "source_url string, description string, source_type string, is_official boolean").withColumn("title", F.lit("t"))
    got = {r.source_url: (r.gdpr_status, r.gdpr_action, r.description) for r in gates.gdpr_gate(df).collect()}
    assert got["u1"][:2] == ("compliant", "none") and got["u2"] == ("compliant", "anonymized", "mail [email usuniety]")
    assert got["u3"][:2] == ("needs_review", "none") and got["u4"][:2] == ("non_compliant", "rejected")
    raw = df.selectExpr("*", "'n' as source_name", "cast(null as string) as raw_text", "'' as date", "'2024-01-01' as timestamp", "'pl' as country_code", "'en' as language", "0.5D as trust_score")
    ok, bad = ing.ingest(raw, ing.starter(spark))
    assert ok.count() + bad.count() == len(rows)
    assert [(r.source_url, r.reject_reason) for r in bad.collect()] == [(None, "no_source_url")]


def test_insert_new(spark):
    cols = "source_url string, title string, raw_text string, severity string, event_type string, date_collected timestamp_ntz"
    new = spark.createDataFrame([("a", "x" * 600, None, None, None, T0), ("a", "later", "", "low", "delay", T0 + dt.timedelta(1)), ("b", "t", "", "low", "delay", T0), (None, "n", "", "low", "delay", T0), (None, "n", "", "low", "delay", T0)], cols)
    old = spark.createDataFrame([("b",)], "source_url string")
    got = sorted((r.source_url or "", len(r.title), r.severity) for r in ir.insert_new(new, old, title_chars=500).collect())
    assert got == [("", 1, "low"), ("", 1, "low"), ("a", 500, "medium")]
    assert ir.insert_new(new, old).where("length(title) = 600").count() == 1  # whole unless a limit is given


def test_throttle_batch_equals_replay(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice("ab"), T0 + dt.timedelta(milliseconds=rnd.randrange(60_000))) for i in range(300)] + [(900, "c", T0), (901, "c", T0 + dt.timedelta(milliseconds=900)), (902, "c", T0 + dt.timedelta(seconds=1))]
    want, last = set(), {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() >= 1.0:
            last[k] = t
            want.add(i)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz")
    assert {r.id for r in streams.throttle_batch(df, "k", "ts", 1.0, bucket_s=7).collect()} == want


def test_top_n_and_mode(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert {(r.k, r.m) for r in sizes.mode_of(df, ["k"], "v", "m").collect()} == {("a", 1), ("b", 5)}


def test_road_alert_files(spark, tmp_path):
    p = str(tmp_path / "ra")
    row = ("2024-01-01T10:00:00", "PL", "accident", "A2", "d" * 600, None, "en", "raw", 50.0, 10.0)
    road_alerts.write_road_alerts(spark.createDataFrame([row, ("bad time", *row[1:])], road_alerts.SCHEMA), p)
    (tmp_path / "ra" / "x.json").write_text("{broken\n")
    got = road_alerts.read_road_alerts(spark, p, "2024-01-01 12:00:00").collect()
    assert [(len(r.description), r.source_channel) for r in got] == [(500, "unknown")]


LISTING = """<html><body><div class="news"><article><h3>Truck robbery near border</h3><a href="/n/1">more</a><time datetime="2024-01-05">x</time><p>Cargo stolen &amp; gone</p></article>
<article><h3>abc</h3></article><article><h3>Second item title</h3><span class="date">05.02.2024</span><p>Text</p></article></div></body></html>"""
ARTICLE = "<html><body><nav><p>skip me please, this is navigation</p></nav><div class='ad-box'><p>ads</p></div><article><p>" + "First paragraph of text. " * 3 + "<p>Second paragraph.</p></article></body></html>"
BOARD = '<ul class="topiclist"><li class="row"><a class="topictitle" href="/viewtopic?t=1">Stolen trailer in Brno</a></li></ul>'


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://p.org/list", LISTING), (2, "https://p.org/a", ARTICLE), (3, "https://f.org/b", BOARD)], "page_id long, url string, html string")
    items = pages.page_items(df.where("page_id = 1"), {"selectors": ["div.news article"], "domain": "https://p.org"}).orderBy("pos").collect()
    assert [(r.title, r.source_url, r.description, r.date) for r in items] == [
        ("Truck robbery near border", "https://p.org/n/1", "Cargo stolen & gone", "2024-01-05"), ("Second item title", "https://p.org/list", "Text", "05.02.2024")]
    text = {r.page_id: r.article for r in pages.article_text(df).collect()}
    assert text[2].startswith("First paragraph") and text[2].endswith("Second paragraph.") and "navigation" not in text[2] and "ads" not in text[2]
    board = pages.forum_items(df.where("page_id = 3")).first()
    assert (board.engine, board.title, board.source_url) == ("phpbb", "Stolen trailer in Brno", "https://f.org/viewtopic?t=1")


def test_page_nested_deeper_than_python_recurses():
    from cordon.sources.pages import main_text

    deep = "<article>" + "<li>" * 3000 + "<p>" + "word " * 20 + "</p>"
    assert main_text(deep) == ("word " * 20).strip()


def test_texts_are_cut_only_to_given_limits(spark):
    from cordon.sources.road_alerts import SCHEMA, alert_rows

    long = "x" * 9000
    row = spark.createDataFrame([("t", None, "accident", "A1", long, None, "en", long, None, None)], SCHEMA)
    whole, short = alert_rows(row).first(), alert_rows(row, 500, 2000).first()
    assert (len(whole["description"]), len(whole["raw_text"])) == (9000, 9000)
    assert (len(short["description"]), len(short["raw_text"])) == (500, 2000)


def test_names_in_a_long_text_and_in_repeated_rows(spark):
    from cordon.operators import joins as j

    texts = spark.createDataFrame([(1, "ab " * 20000 + "Long Name Ltd"), (2, "long name ltd"), (2, "long name ltd"), (3, None)], "i long, t string")
    names = spark.createDataFrame([(7, "LONG NAME"), (8, "ab"), (9, "missing name")], "n long, name string")
    for rows in (200_000, 0):
        got = sorted(map(tuple, j.contained(texts, "i", "t", names, "n", "name", rows).collect()))
        assert got == [(1, 7), (1, 8), (2, 7), (2, 7)]


def test_look_back_over_stored_days(spark, tmp_path):
    """A new day added to the store, also twice, gives what a scan of all rows gives, at midnight and between."""
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["PL", "DE"]), rnd.choice(["R1", None]), "delay", T0 + dt.timedelta(seconds=rnd.randrange(10 * 86400))) for i in range(400)]
    rows += [(900, "PL", "R1", "delay", T0 + dt.timedelta(days=2)), (901, "PL", "R1", "delay", T0 + dt.timedelta(days=9)), (902, "PL", "R1", "delay", None)]
    inc = spark.createDataFrame(rows, "id long, country_code string, region string, event_type string, date_collected timestamp_ntz")
    path = str(tmp_path / "days")
    for lo, hi in ((0, 6), (6, 9), (6, 9), (9, 10)):
        part = inc.where((F.col("date_collected") >= F.lit(T0 + dt.timedelta(days=lo))) & (F.col("date_collected") < F.lit(T0 + dt.timedelta(days=hi))))
        al.store_days(part, path)
    days = spark.read.parquet(path)
    for as_of in (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 9, 13, 30)):
        want = {}
        for _, cc, region, kind, at in rows:
            if at is not None and as_of - dt.timedelta(days=7) <= at <= as_of:
                want[cc, region, kind] = want.get((cc, region, kind), 0) + 1
        got = {tuple(r)[:3]: r.n for r in al.look_back(days, inc, as_of, 7).collect()}
        assert got == want


def test_names_and_requests_never_fill_the_driver(spark):
    """Tables of names that Spark takes for small stay out of broadcasts, whatever it may broadcast; same pairs."""
    from cordon.operators import company

    n = [(i, f"Firm No {i:05d}", "PL", "x", "healthy", 1.0, f"PL{i}") for i in range(300)]
    co = spark.createDataFrame(n, "id long, name string, country_code string, company_type string, financial_status string, risk_score double, tax_id string")
    req = co.selectExpr("id as req_id", "name", "country_code")
    texts = spark.createDataFrame([(i, f"é{i} about firm no {i:05d}.") for i in range(0, 300, 3)], "t long, text string")
    named = joins.contained(texts, "t", "text", co, "id", "name", broadcast_rows=0)
    assert sorted(map(tuple, named.collect())) == [(i, i) for i in range(0, 300, 3)]
    inc = spark.createDataFrame([], "id long, company_id long, date_collected timestamp_ntz")
    found, near = joins.resolve_company(req, co), company.related_enrich(req, co, inc, T0)
    assert [r.company_id for r in found.orderBy("req_id").collect()] == list(range(300))
    for df in (named, found, near):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_texts_wait_for_python_without_the_lists_of_places(spark):
    """Rows on their way to the phrase kernel hold no folded list of roads, regions, crossings or parks."""
    from cordon.operators import enrich as e

    d = spark.createDataFrame([(1, "Near Lyon on A7", "FR")], "id long, x string, cc string")
    g = e.geo_extract(d, "id", F.col("x"), F.col("cc"), e.gazetteer(spark), e.highway_ref(spark), e.region_ref(spark), joins.borders(spark), joins.truck_parks(spark), joins.corridor_members(spark))
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("ArrowEvalPython", 1)[1]
    assert (g.first()["city"], g.first()["highway"]) == ("Lyon", "A7")


def test_report_counts_equal_pairs(spark):
    """Sums over lists of countries against the pairs themselves; order and repeats in a list do not matter."""
    rnd = random.Random(4)
    lists = [None, [], ["PL"], ["PL", "PL", "DE"], ["DE", "PL"], ["FR"], ["*", "PL"], ["+"]]
    r = spark.createDataFrame([(i, rnd.choice(lists)) for i in range(60)], "id long, countries array<string>")
    s = spark.createDataFrame([(i, i % 5 > 0, rnd.choice(lists)) for i in range(40)], "id long, is_active boolean, subscribed_countries array<string>")
    want = joins.fan_out_reports(r, s).groupBy("subscriber_id").agg(F.count(F.lit(1)), F.sum("report_id"))
    assert sorted(map(tuple, joins.report_counts(r, s).collect())) == sorted(map(tuple, want.collect()))


def test_routes_of_one_course_are_measured_once(spark):
    """Every route and point of the buffer, with the distances taken per spot and course."""
    pts = [(i, 50.0 + (i % 4) * 0.3, 10.0 + (i % 3) * 0.4) for i in range(60)]
    p = spark.createDataFrame([*pts, (99, None, 10.0)], "id long, latitude double, longitude double")
    r = spark.createDataFrame([(i, 50.0, 9.0 + i % 2, 50.0, 11.0 + i % 2) for i in range(6)], "route_id long, from_lat double, from_lon double, to_lat double, to_lon double")
    got = {(x.route_id, x.id): x.km for x in joins.route_join(p, r, 60.0).collect()}
    near = joins._near_course(p.where("latitude is not null").select("latitude", "longitude").distinct(), joins.shapes(r), 60.0).collect()
    assert len(near) <= 12 * 2
    km_of = {(x.route_id, x.latitude, x.longitude): x.km for x in near}
    assert got == {(i, q): km_of[i % 2, la, lo] for i in range(6) for q, la, lo in pts if (i % 2, la, lo) in km_of} and got


def test_hotspots_of_two_companies_at_one_place_agree_with_sql(spark, tmp_path):
    """Companies 0 and 5917 share a place, so their events are one hotspot, in the query and in its SQL."""
    import duckdb

    from cordon.catalog import registry

    registry.load()
    rows = [(i, T0 + dt.timedelta(hours=i), 0 if i % 2 else 5917, "view", 1.0, "{}") for i in range(10)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(registry.ORACLES["hotspots"]).fetchall()
    got = registry.QUERIES["hotspots"](spark, str(tmp_path)).collect()
    assert [(r.seed_id, r.event_count, r.country_code) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r.event_count for r in got] == [10]


def test_whole_groups_and_jumps():
    """Groups torn by batches come whole; jumps stay in their group, also where groups do not fit one axis of 64 bits."""
    import numpy as np
    import pandas as pd

    d = pd.DataFrame({"key": list("aaabbcccc"), "us": [0, 4, 9, 0, 5, 1, 2, 1 << 61, (1 << 61) + 5]})
    for n in range(1, 10):
        got = list(streams.whole_groups((d.iloc[i:i + n] for i in range(0, 9, n)), ["key"]))
        assert pd.concat(got, ignore_index=True).equals(d)
        assert sum(g["key"].nunique() for g in got) == 3
    group = streams._numbered(d, ["key"])
    assert streams._jumps(group, d["us"].to_numpy(), 5).tolist() == [2, 2, -1, 4, -1, 7, 7, 8, -1]
    assert streams._walk(np.array([0, 3, 5]), np.array([2, 2, -1, 4, -1, 7, 7, 8, -1])) == [0, 2, 3, 4, 5, 7, 8]

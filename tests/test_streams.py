"""Streams against their batch twins on complete data."""

import datetime as dt

from pyspark.sql import functions as F

from cordon.operators import alerts as a
from cordon.plans import ingest as ing
from cordon.streaming import streams

T0 = dt.datetime(2024, 1, 1)
INC = "id long, country_code string, region string, event_type string, severity string, title string, source_url string, date_collected timestamp_ntz"


def rows(n=60):
    return [(i, "PL" if i % 3 else "DE", f"R{i % 2}", "delay", "critical" if i % 20 == 0 else "low", f"t{i}", f"u{i % 50}", T0 + dt.timedelta(minutes=2 * i)) for i in range(n)]


def feed(spark, tmp_path, parts):
    path = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, INC).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(INC).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_spike_stream_matches_windows(spark, tmp_path):
    src = feed(spark, tmp_path, [rows(), [(999, "XX", "Z", "delay", "low", "late", "z", T0 + dt.timedelta(days=2))]])
    got = {tuple(r) for r in drain(streams.spike_stream(src), "spikes").collect()}
    want = {tuple(r) for r in a.spike_windows(spark.createDataFrame(rows(), INC)).collect()}
    assert got == want and want


def test_dedup_and_critical(spark, tmp_path):
    src = feed(spark, tmp_path, [rows(), rows(30)])  # the second file repeats the first rows
    assert drain(streams.dedup_stream(src, "id"), "dedup").count() == 60
    assert drain(streams.critical_stream(src), "crit").count() == 3


def test_throttle_stream(spark, tmp_path):
    msgs = [(i, "PL", "c", "x", "low", "t", "u", T0 + dt.timedelta(milliseconds=ms)) for i, ms in enumerate([0, 900, 1000, 1500, 2000, 2999])]
    src = feed(spark, tmp_path, [msgs[:3], msgs[3:]])
    got = drain(streams.throttle(src, "country_code", "date_collected"), "throttle")
    assert sorted(r.id for r in got.collect()) == [0, 2, 4]


def test_stale_stream(spark, tmp_path):
    beat = lambda i, cc, m: (i, cc, "r", "x", "low", "t", "u", T0 + dt.timedelta(minutes=m))
    src = feed(spark, tmp_path, [[beat(1, "PL", 0), beat(2, "DE", 0)], [beat(3, "DE", 20)], [beat(4, "FR", 21)]])
    beats = src.select("country_code", F.lit("rss").alias("agent_type"), F.col("date_collected").alias("at"))
    assert "PL" in {r.country_code for r in drain(streams.stale_stream(beats), "stale").collect()}


def test_ingest_stream_inserts_once(spark, tmp_path):
    cols = "source_url string, source_name string, title string, description string, raw_text string, source_type string, date string, timestamp string, country_code string, language string, trust_score double, is_official boolean"
    row = lambda u, text: (u, "s", "Cargo theft", text, None, "news", "", "2024-01-01", "PL", "en", 0.5, False)
    path = str(tmp_path / "raw")
    for part in ([row("u1", "x"), row("u2", "mail a@b.pl"), row(None, "y")], [row("u1", "again"), row("u3", "z")]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path)
    pick = lambda d: d.select("source_url", "title", "description", "raw_text", "event_type", "severity", F.lit(T0).cast("timestamp_ntz").alias("date_collected"))
    store, rej = str(tmp_path / "store"), str(tmp_path / "rej")
    q = streams.ingest_stream(src, ing.starter(spark), store, rej, str(tmp_path / "ck"), pick).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.source_url for r in spark.read.parquet(store).collect()) == ["u1", "u2", "u3"]
    assert [r.reject_reason for r in spark.read.parquet(rej).collect()] == ["no_source_url"]


def test_repeated_batches_change_nothing(spark, tmp_path):
    """A batch written again after a failure, even after later batches, leaves the store as it was."""
    cols = "source_url string, source_name string, title string, description string, raw_text string, source_type string, date string, timestamp string, country_code string, language string, trust_score double, is_official boolean"
    row = lambda u: (u, "s", "Cargo theft", "x", None, "news", "", "2024-01-01", "PL", "en", 0.5, False)
    batches = [spark.createDataFrame([row(u) for u in urls], cols) for urls in (["u1", "u2", None], ["u2", "u3"])]
    pick = lambda d: d.select("source_url", "title", "description", "raw_text", "event_type", "severity", F.lit(T0).cast("timestamp_ntz").alias("date_collected"))
    store, rejects, refs = str(tmp_path / "store"), str(tmp_path / "rejects"), ing.starter(spark)
    seen = []
    for i, days in ((0, None), (0, None), (1, 7), (0, 7)):
        streams.write_batch(batches[i], i, refs, store, rejects, pick, days)
        seen.append(sorted((r.source_url, r.batch) for r in spark.read.parquet(store).collect()))
    assert seen[0] == seen[1] == [("u1", 0), ("u2", 0)] and seen[2] == seen[3] == [*seen[0], ("u3", 1)]
    assert spark.read.parquet(rejects).count() == 1


def test_dual_sink_repeats(spark, tmp_path):
    msgs = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, True)], "id long, stream_incident boolean, stream_road boolean")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for part, i in ((msgs.where("id < 3"), 0), (msgs.where("id = 3"), 1), (msgs.where("id < 3"), 0)):
        streams.write_both(part, i, a, b)
    assert sorted(r.id for r in spark.read.json(a).collect()) == [1, 2] and sorted(r.id for r in spark.read.json(b).collect()) == [2, 3]


def test_one_alert_per_country_and_gap(spark, tmp_path):
    """Windows in batches, one of them repeated, raise what all windows at once raise, and what the serial rule says."""
    windows = a.spike_windows(spark.createDataFrame(rows(200), INC)).cache()
    got = streams.one_per_country(windows)
    want, last = [], {}
    for r in sorted(windows.collect(), key=lambda r: r.win_end):
        if r.country_code not in last or r.win_end - last[r.country_code] >= dt.timedelta(minutes=30):
            last[r.country_code] = r.win_end
            want.append(tuple(r))
    assert sorted(tuple(r) for r in got.select(*windows.columns).collect()) == sorted(want) and len(want) < windows.count()
    path, half = str(tmp_path / "alerts"), T0 + dt.timedelta(hours=3)
    early, late = windows.where(F.col("win_end") < F.lit(half)), windows.where(F.col("win_end") >= F.lit(half))
    for part, i in ((early, 0), (late, 1), (early, 0), (late, 1)):
        streams.write_alerts(part, i, path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select(*windows.columns).collect()) == sorted(want)


def test_throttle_by_event_time(spark, tmp_path):
    """Messages out of order, repeated, late, at one time and after idle hours: as the table gives them."""
    import random

    deal = random.Random(5)
    ms = sorted(deal.randrange(0, 40_000) for _ in range(150)) + [7_200_000 + 400 * k for k in range(9)] + [7_200_400]
    msgs = [(i, "PL" if i % 3 else "DE", "c", "x", "low", "t", "u", T0 + dt.timedelta(milliseconds=m)) for i, m in enumerate(ms)]
    early = msgs[:150]
    deal.shuffle(early)
    parts = [early[:60], early[60:] + early[:5], msgs[150:]]
    end = (999, "XX", "c", "x", "low", "t", "u", T0 + dt.timedelta(days=1))
    late = (998, "PL", "c", "x", "low", "t", "u", T0)
    src = feed(spark, tmp_path, [*parts, [end], [late], [end]])
    got = drain(streams.throttle(src, "country_code", "date_collected", 2.0, "1 minute", bucket_s=10), "ordered")
    want = streams.throttle_batch(spark.createDataFrame(msgs, INC), "country_code", "date_collected", 2.0)
    assert sorted((r.key, r.id) for r in got.collect() if r.id < 998) == sorted((r.key, r.id) for r in want.collect())
    assert 998 not in {r.id for r in got.collect()}


def test_silences_in_any_order(spark, tmp_path):
    """Two silences of one agent, a gap of exactly the limit, beats out of order and repeated: as the table gives them."""
    minutes = {"PL": [0, 4, 9, 10, 17], "DE": [0, 1, 2, 3, 4, 5, 6, 7], "FR": [3, 8, 60]}
    beat = lambda cc, m: (m, cc, "r", "x", "low", "t", "u", T0 + dt.timedelta(minutes=m))
    beats = [beat(cc, m) for cc, ms in minutes.items() for m in ms]
    parts = [[b for b in beats if b[0] % 3 == k and b[0] < 9] for k in (1, 0, 2)] + [[b for b in beats if 9 <= b[0] < 60], [beat("PL", 10), beat("FR", 60)]]
    src = feed(spark, tmp_path, [*parts, [beat("XX", 70)], [beat("XX", 71)]])
    narrow = lambda d: d.select("country_code", F.lit("rss").alias("agent_type"), F.col("date_collected").alias("at"))
    got = {(r.country_code, r.last_heartbeat) for r in drain(streams.stale_stream(narrow(src), delay="10 minutes"), "silent").collect()}
    at = lambda m: T0 + dt.timedelta(minutes=m)
    want = {("PL", at(10)), ("PL", at(17)), ("DE", at(7)), ("FR", at(8))}
    assert got == want
    batch = streams.silences(narrow(spark.createDataFrame(beats, INC)), F.lit(at(61)).cast("timestamp_ntz"))
    assert {(r.country_code, r.last_heartbeat) for r in batch.collect()} == want

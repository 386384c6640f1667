"""Golden rows for the text operators; own texts for the situations that matter."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cordon.functions import text as t
from cordon.functions import values as v
from cordon.functions.score import severity_of
from cordon.operators import enrich as e
from cordon.operators import filters as f
from cordon.operators import profile as p
from cordon.refdata import terms as W


def run(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", fn("x").alias("y")).orderBy("i").select("y").collect()]


def test_numbers(spark):
    got = run(spark, ["1.234,56", "1,234.56", "1234,5", "1,234", "1.234", " 12 000 ", "", "a1", None], v.parse_number)
    assert got == [1234.56, 1234.56, 1234.5, 1234.0, 1.234, 12000.0, None, None, None]


def test_dates(spark):
    texts = ["2024-02-03T10:11", "on 5.3.24 at", "07/08/2023", "1-12-2022", "15 stycznia 2024", "January 5, 2024", "31.02.2024 or 01/02/2024", "3 août 2021", "none"]
    d = dt.datetime
    assert run(spark, texts, v.parse_date) == [
        d(2024, 2, 3, 10, 11), d(2024, 3, 5), d(2023, 8, 7), d(2022, 12, 1), d(2024, 1, 15), d(2024, 1, 5), d(2024, 2, 1), d(2021, 8, 3), None]


def test_money_takes_the_largest_in_euro(spark):
    got = run(spark, ["EUR 85,000 and 10 zł", "strata 10 000 zł", "£100 or $90", "nothing", "€ 1.234,50"], v.money_eur)
    assert got == [85000.0, 2300.0, 116.0, None, 1234.5]


def test_scrub_kinds_and_idempotence(spark):
    texts = ["mail a.b@c.pl now", "id ABC 123456 end", "call +48 600 100 200", "PL12 3456 7890 1234 5678", "clean", "", None]
    once = run(spark, texts, t.scrub_pii)
    assert once[0] == "mail [email usuniety] now" and once[1] == "id [ID usuniete] end"
    assert once[2] == "call [telefon usuniety]" and once[4:] == ["clean", "", None]
    assert run(spark, once, t.scrub_pii) == once
    assert run(spark, texts, t.has_pii) == [True, False, True, True, False, False, False]


def test_company_key(spark):
    names = ["  nordic   trans sp. z o.o.", "Firma Żółw GmbH", "ABC Transport Ltd.", "o'neil haulage", '"Quoted Cargo" SA', ""]
    assert run(spark, names, t.company_key) == ["Nordic Trans", "Żółw", "ABC Transport", "O'Neil Haulage", "Quoted Cargo", ""]


def test_neutral_words(spark):
    assert run(spark, ["Fraud and Dieb, Diebstahl"], t.neutralise) == ["incident and gemeldete Person, Diebstahl"]
    assert run(spark, ["Diebstahl"], lambda c: t.neutralise(c, compat=True)) == ["gemeldete Personstahl"]


def test_mask_companies(spark):
    df = spark.createDataFrame([("Nordic Trans GmbH met „Fast Cargo”", "PL-R1")], "x string, r string")
    got = df.select(t.mask_companies("x", "r")).first()[0]
    assert "Nordic" not in got and "Fast" not in got and got.count("firma transportowa z regionu PL-R1") == 2


def test_strip_html_and_normalise(spark):
    assert run(spark, ["<p>a &amp; <b>b</b></p>\n c", None], t.strip_html) == ["a & b c", ""]
    assert run(spark, ["é  x\t\ty\n\n\n\nz "], t.normalise_text) == ["é x y\n\nz"]


def test_small_patterns(spark):
    assert run(spark, ["crash on a2 km 340 today", "E40 closed", "no"], t.road_km) == ["A2 km 340", "E40", None]
    assert run(spark, ["Title - More - Daily Post", "plain"], t.origin) == ["Daily Post", ""]
    assert run(spark, ["https://www.x.org/a?b", "http://m.y.net"], t.host_of) == ["x.org", "m.y.net"]


@pytest.mark.parametrize("kind,text,money,want", [
    ("theft_cargo", "", 50_000.0, "high"), ("theft_cargo", "", 50_000.5, "critical"), ("theft_vehicle", "", None, "high"),
    ("bankruptcy", "", 1_000_000.0, "high"), ("bankruptcy", "", 1_000_001.0, "critical"), ("strike", "a local strike", None, "medium"),
    ("strike", "Nationwide strike", None, "high"), ("delay", "", None, "low"), ("other", "", None, "info"), ("license_revoked", "", None, "high"),
])
def test_severity(spark, kind, text, money, want):
    df = spark.createDataFrame([(kind, text, money)], "k string, t string, m double")
    assert df.select(severity_of("k", "t", "m")).first()[0] == want


def classify(spark, rows, terms):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, language string")
    return [r[0] for r in e.classify_type(df, terms, F.col("text")).orderBy("i").select("event_type").collect()]


def test_type_scores(spark):
    terms = W.terms(spark, ("en", W.TYPE_TERMS), ("de", {"theft_cargo": "ladungsdiebstahl", "damage": "unfall"}))
    # group ranks of a second language follow its own order, so compare by meaning only
    got = classify(spark, [
        ("Cargo theft near the depot", "en"), ("Unfall, also a delay", "de"), ("fuel siphoned last night", "xx"), ("nothing here", "en"),
        ("No cargo theft happened", "en"), ("thieves at work", "en"), ("Ladungsdiebstahl", "de"), ("", "pl"),
    ], terms)
    assert got == ["theft_cargo", "damage", "theft_fuel", "other", "theft_cargo", "other", "theft_cargo", "other"]


def test_two_list_relevance(spark):
    veh, evt = W.terms(spark, ("en", W.VEHICLE_TERMS)), W.terms(spark, ("en", W.EVENT_TERMS))
    rows = [("truck robbery on the motorway", "en"), ("bicycle theft", "en"), ("new truck model", "en"), ("stolen lorry", "xx")]
    df = spark.createDataFrame(rows, "text string, language string")
    got = {r.text: r.is_transport for r in f.is_transport(df, veh, evt, F.col("text")).collect()}
    assert got == {rows[0][0]: True, rows[1][0]: False, rows[2][0]: False, rows[3][0]: True}


def test_tags_and_tier(spark):
    df = spark.createDataFrame([(0, "Night theft of electronics, cargo stolen", None), (1, "nothing", "strike"), (2, "plain", None)], "i int, text string, event_type string")
    tags = e.tags(df, W.terms(spark, ("en", W.TAG_TERMS)), F.col("text")).orderBy("i").collect()
    assert tags[0].tags == ["nocna", "elektronika"] and tags[1].tags == []
    tier = e.tier(df, W.terms(spark, ("en", W.TIER_TERMS)), F.col("text")).orderBy("i").collect()
    assert [(r.intelligence_tier, r.intelligence_category, r.intelligence_confidence) for r in tier] == [
        (1, "cargo_theft", 0.5), (3, "protest_roadblock", 0.5), (4, "general_news", 0.2)]


def test_vehicle_origin_and_mo(spark):
    assert run(spark, ["a UK-registered lorry", "plate PL 123 45", "nothing"], lambda c: e.vehicle_country(F.col(c))) == ["GB", "PL", None]
    assert run(spark, ["the curtain slashed", "diesel wurde abgezapft", "x"], lambda c: e.modus_operandi(F.col(c))) == ["curtain_slashed", "fuel_theft", None]


def test_long_runs_of_words_and_numbers(spark):
    """Runs of capitalised words used to overflow the stack, and numbers without a currency took steps by their square."""
    words, numbers = "Alpha Beta " * 10_000, "12 34,5 " * 10_000
    texts = [words, words + "Gamma GmbH " + words, "Alpha AGnes Beta AG Gamma", numbers, numbers + "and EUR 7", None]
    assert run(spark, texts, lambda c: F.transform(p.ent_companies(F.col(c)), F.length)) == [[], [len(words) + 10], [19], [], [], []]
    assert run(spark, texts[3:], lambda c: F.size(p.ent_amounts(F.col(c)))) == [0, 1, 0]
    assert run(spark, [numbers, numbers + "and EUR 7", None], v.money_eur) == [None, 7.0, None]

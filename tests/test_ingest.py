"""Nothing of the untouched text leaves the ingest chain but its hash."""

import hashlib

from cordon.plans import ingest as ing
from cordon.plans.ingest import ingest_tables, starter
from cordon.refdata import terms as W


def test_no_personal_data_in_any_output(spark):
    names = ["title", "description", "raw_text", "date", "timestamp", "country_code", "region", "city", "language", "source_url", "source_name", "source_type"]
    mail = "jan.kowalski@example.org"
    rows = [
        ("Truck stolen", f"Write to {mail}", f"Cargo theft on the A2. Contact {mail}. " + "long " * 2000 + "bankruptcy", None, "2024-01-02", "PL", None, None, "en", "https://n.example.org/1", "s", "news"),
        (f"Mail {mail}", "", "", None, "2024-01-02", "PL", None, None, "", "https://facebook.com/login", "s", "news"),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).selectExpr("*", "false as is_official", "0.5D as trust_score")
    ok, rejected, audit, review = ingest_tables(raw, starter(spark))
    for table in (ok, rejected, audit, review):
        assert mail not in str(table.collect())
    assert ok.count() + rejected.count() == audit.count() == 2
    whole = ok.unionByName(rejected).where("source_url like '%/1'").first()
    assert len(whole["raw_text"]) > 10_000  # no cut
    assert whole["original_hash"] == hashlib.sha256("\n".join(rows[0][:3]).encode()).hexdigest()


def test_stored_rows_are_tiered_placed_and_linked(spark):
    """Own values stay, names link by key and country first, unknown and null names to nothing; a table of untiered rows alike."""
    cols = "source_url string, source_name string, title string, description string, raw_text string, source_type string, date string, timestamp string, country_code string, language string, trust_score double, is_official boolean, company_name string, latitude double"
    row = lambda k, text, cc, name, lat=None: (f"u{k}", "s", text, text, None, "news", "", "2024-01-01", cc, "en", 0.5, False, name, lat)
    raw = spark.createDataFrame([row(1, "Cargo theft near Warszawa", "PL", "ACME  Trans."), row(2, "Quiet day", "DE", "acme trans", 1.5), row(3, "Quiet day in Berlin", "FR", "Acme-Trans"), row(4, "Quiet", None, None), row(5, "x", "PL", "!?"), row(6, "", "PL", "Other")], cols)
    refs = ing.starter(spark)
    refs.companies = spark.createDataFrame([(7, "Acme Trans", "PL"), (3, "ACME TRANS", "PL"), (5, "acme trans", "DE"), (9, None, "PL"), (1, "?", "PL")], "id long, name string, country_code string")
    refs.tiers = spark.createDataFrame([("1/cargo_theft", 0, "*", "cargo theft", 0)], W.SCHEMA)
    got = {r.source_url: r for r in ing.staged(raw, refs).collect()}
    assert {k: r.company_id for k, r in got.items()} == {"u1": 3, "u2": 5, "u3": 3, "u4": None, "u5": None, "u6": None}
    assert got["u1"].intelligence_tier == 1 and round(got["u1"].latitude) == 52 and got["u2"].latitude == 1.5 and got["u2"].longitude is None
    assert got["u4"].intelligence_tier == 4 and got["u4"].latitude is None and len(got) == 6

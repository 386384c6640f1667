"""Registry shape, and a sample of queries against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["event_stats", "event_list", "trend_series", "spike_windows", "company_bursts", "classify_type", "scrub_pii", "company_risk", "alert_fan_out", "insert_new", "report_recommendations"]


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.cells(got) == check.cells(want)

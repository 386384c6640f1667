"""Risk scores keep all that they are made of."""

import datetime as dt

from cordon.operators.risk import route_risk


def test_route_risk_names_every_area(spark):
    """Seven areas on a route, one of them twice, one by region only, one row without any."""
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "theft_cargo", at, f"City{k}", "R", "A2" if k % 2 else "") for k in (5, 3, 6, 1, 2, 4, 4)]
    rows += [(1, "delay", at, "", "R", None), (1, "delay", at, None, "", "A2"), (2, "delay", at, None, None, None)]
    on = spark.createDataFrame(rows, "route_id long, event_type string, date_occurred timestamp_ntz, city string, region string, road string")
    got = {r.route_id: (r.event_count, r.high_risk_areas) for r in route_risk(on, None, "2024-01-02 00:00:00").collect()}
    assert got == {1: (9, ["City1 (A2)", "City2", "City3 (A2)", "City4", "City5 (A2)", "City6", "R"]), 2: (1, None)}

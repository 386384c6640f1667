"""Risk of companies, routes, regions and cargo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions.score import days_since, decay, lookup, peak_band, risk_level, weight
from cordon.operators.joins import region_links
from cordon.refdata import fixed as V
from cordon.session import cut


def _cap(c: Column) -> Column:
    return F.least(F.lit(100.0), F.round(c, 1))


def company_risk(inc: DataFrame, fin: DataFrame | None, as_of, max_types: int | None = None) -> DataFrame:
    """Score, level, trend, factors and advice per company. ``fin`` holds
    ``(company_id, metric, value)``; payment delays over 60 days add 15 each."""
    e = inc.where(F.col("company_id").isNotNull()).select(
        "company_id", "event_type", decay("date_occurred", as_of).alias("d"), (weight() * decay("date_occurred", as_of)).alias("w")
    )
    per = e.groupBy("company_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.count_if(F.col("d") == 1.0).alias("recent"),
        F.count_if((F.col("d") > 0.5) & (F.col("d") < 1.0)).alias("older"),
    )
    kind = lambda types: F.sum(F.when(F.col("event_type").isin(types), F.col("w")).otherwise(0.0))
    has = lambda t: F.max(F.when(F.col("event_type") == t, 1).otherwise(0)) > 0
    g = per.groupBy("company_id").agg(
        F.sum("n").alias("event_count"), kind(V.FINANCIAL_TYPES).alias("fin"), kind(V.OPERATIONAL_TYPES).alias("op"),
        F.sum("recent").alias("recent"), F.sum("older").alias("older"),
        has("bankruptcy").alias("has_bankruptcy"), has("license_revoked").alias("has_revocation"),
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "event_type", "n"))).alias("types"),  # at most the number of types
    )
    mult = F.when(F.col("recent") >= 5, 2.0).when(F.col("recent") >= 3, 1.5).otherwise(1.0)
    if fin is None:
        g = g.withColumn("delays", F.lit(0).cast("bigint"))
    else:
        late = fin.where((F.col("metric") == "payment_delays") & (F.col("value") > 60)).groupBy("company_id").agg(F.count(F.lit(1)).alias("delays"))
        g = g.join(late, "company_id", "left").withColumn("delays", F.coalesce("delays", F.lit(0)))
    extra = F.col("delays") * 15
    out = g.select(
        "company_id", "event_count", "recent", "older", "types", "has_bankruptcy", "has_revocation", "delays",
        F.least(F.lit(100.0), _cap(F.col("fin") * mult) + extra).alias("financial_score"),
        _cap(F.col("op") * mult).alias("operational_score"),
        F.least(F.lit(100.0), _cap((F.col("fin") + F.col("op")) * mult) + extra).alias("overall_score"),
    )
    trend = F.when(F.col("recent") > F.col("older") * 1.5, "RISING").when(F.col("recent") < F.col("older") * 0.5, "DECLINING").otherwise("STABLE")
    out = out.withColumn("risk_level", risk_level("overall_score")).withColumn("trend", trend)
    freq = F.when(F.col("recent") >= 5, F.format_string("%d events in last 30 days (high frequency)", "recent")).when(
        F.col("recent") >= 3, F.format_string("%d events in last 30 days (elevated frequency)", "recent")
    )
    top = F.transform(F.col("types") if max_types is None else F.slice("types", 1, max_types), lambda t: F.concat(t["n"].cast("string"), F.lit("x "), t["event_type"]))
    advice = F.array_compact(
        F.array(
            F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), "enhanced_due_diligence"),
            F.when(F.col("financial_score") >= 40, "review_receivables"),
            F.when(F.col("has_bankruptcy"), "verify_legal_status"),
            F.when(F.col("has_revocation"), "confirm_licence"),
            F.when(F.col("operational_score") >= 40, "monitor_operations"),
            F.when(F.col("trend") == "RISING", "plan_alternatives"),
        )
    )
    out = out.withColumn("factors", F.concat(F.array_compact(F.array(freq)), top)).withColumn("advice", advice)
    return out.withColumn("advice", F.when(F.size("advice") == 0, F.array(F.lit("standard_monitoring"))).otherwise(F.col("advice"))).drop(
        "types", "has_bankruptcy", "has_revocation", "recent", "older", "delays"
    )


def is_night(ts="date_occurred") -> Column:
    h = F.hour(ts)
    return (h >= 22) | (h < 5)


def route_risk(on_route: DataFrame, hotspots: DataFrame | None, as_of) -> DataFrame:
    """Per route, from ``(route_id, incident columns)`` rows and stored hotspots
    ``(route_id)``: decayed weights, five per hotspot, three per night event, all distinct areas in order."""
    area = F.coalesce(F.nullif("city", F.lit("")), F.nullif("region", F.lit("")))
    label = F.when(F.coalesce("road", F.lit("")) != "", F.concat(area, F.lit(" ("), F.col("road"), F.lit(")"))).otherwise(area)
    e = on_route.select("route_id", (weight() * decay("date_occurred", as_of)).alias("w"), is_night().alias("night"), label.alias("area"))
    g = e.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("w").alias("w"), F.count_if("night").alias("night_events")
    )
    areas = e.where(F.col("area").isNotNull()).select("route_id", "area").distinct()
    g = g.join(areas.groupBy("route_id").agg(F.sort_array(F.collect_list("area")).alias("high_risk_areas")), "route_id", "left")
    if hotspots is not None:
        g = g.join(hotspots.groupBy("route_id").agg(F.count(F.lit(1)).alias("hotspots")), "route_id", "left")
    else:
        g = g.withColumn("hotspots", F.lit(0).cast("bigint"))
    g = g.withColumn("hotspots", F.coalesce("hotspots", F.lit(0)))
    score = _cap(F.col("w") + F.col("hotspots") * 5 + F.col("night_events") * 3)
    out = g.select("route_id", "event_count", "hotspots", "night_events", score.alias("overall_score"), "high_risk_areas")
    out = out.withColumn("risk_level", risk_level("overall_score"))
    advice = F.array_compact(
        F.array(
            F.when(F.col("risk_level").isin("CRITICAL", "HIGH"), "alternative_route"), F.when(F.col("night_events") > 0, "avoid_night_stops"),
            F.when(F.col("hotspots") > 0, "use_secure_parking"),
        )
    )
    return out.withColumn("advice", F.when(F.size(advice) == 0, F.array(F.lit("standard_precautions"))).otherwise(advice))


def region_risk(inc: DataFrame, req: DataFrame, as_of) -> DataFrame:
    """Per request ``(req_id, country_code, region)``: score, main type, peak band
    and trend. Requests without events score zero. Incidents are summed up by country, region, type,
    hour and decay step first; requests meet these sums, never incidents."""
    e = inc.where(F.col("country_code").isNotNull()).select(
        F.upper("country_code").alias("_cc"), F.lower(F.coalesce("region", F.lit(""))).alias("_reg"), "event_type", F.hour("date_occurred").alias("_h"), decay("date_occurred", as_of).alias("d")
    )
    sums = cut(e.groupBy("_cc", "_reg", "event_type", "_h", "d").agg(F.count(F.lit(1)).alias("n")))
    m = region_links(sums.select("_cc", "_reg").distinct(), req).join(sums, ["_cc", "_reg"])
    m = m.groupBy("req_id", "event_type", "_h", "d").agg(F.sum("n").alias("n"))
    g = m.groupBy("req_id").agg(
        F.sum("n").alias("event_count"), F.sum(weight() * F.col("d") * F.col("n")).alias("w"),
        F.sum(F.when(F.col("d") >= 0.75, F.col("n")).otherwise(0)).alias("recent"), F.sum(F.when(F.col("d") < 0.75, F.col("n")).otherwise(0)).alias("older"),
    )

    def most(rows, col, out):
        c = rows.groupBy("req_id", col).agg(F.sum("n").alias("_n"))
        return c.groupBy("req_id").agg(F.min_by(col, F.struct(-F.col("_n"), F.col(col))).alias(out))

    kind, hour = most(m, "event_type", "dominant_type"), most(m.where(F.col("_h").isNotNull()), "_h", "_h")
    trend = (
        F.when(F.col("recent") > F.col("older") * 1.5, "RISING")
        .when((F.col("recent") < F.col("older") * 0.5) & (F.col("older") > 0), "DECLINING").otherwise("STABLE")
    )
    out = req.select("req_id").join(g, "req_id", "left").join(kind, "req_id", "left").join(hour, "req_id", "left")
    score = F.coalesce(_cap(F.col("w")), F.lit(0.0))
    return out.select(
        "req_id", F.coalesce("event_count", F.lit(0)).alias("event_count"), score.alias("overall_score"), risk_level(score).alias("risk_level"),
        F.coalesce("dominant_type", F.lit("other")).alias("dominant_type"), F.when(F.col("_h").isNotNull(), peak_band("_h")).alias("peak_hours"),
        F.coalesce(trend, F.lit("STABLE")).alias("trend"),
    )


def cargo_risk(df: DataFrame, cargo="cargo_type", route_score="route_score", night="night_risk") -> DataFrame:
    """0-1 risk of a load: base by kind, route score, night on two kinds."""
    base = lookup(V.CARGO_BASE_RISK, F.lower(F.col(cargo)), 0.3)
    one = F.lit(1.0)
    routed = F.when(F.col(route_score).isNull(), base).otherwise(F.least(one, base + F.col(route_score) / 200.0))
    dark = F.coalesce(F.col(night), F.lit(False)) & F.col(route_score).isNotNull() & F.lower(F.col(cargo)).isin("electronics", "pharmaceuticals")
    return df.withColumn("cargo_risk", F.round(F.when(dark, F.least(one, routed + 0.1)).otherwise(routed), 2))


def risk_report(company: DataFrame, route: DataFrame, region: DataFrame) -> DataFrame:
    """One row per subject ``(subject_id, overall_score, advice)`` of any of the
    three: highest score, its level, advice in order without repeats."""
    pre = lambda d, p: d.select("subject_id", F.col("overall_score").alias(f"{p}_score"), *([F.col("advice").alias(f"{p}_advice")] if "advice" in d.columns else []))
    j = pre(company, "company").join(pre(route, "route"), "subject_id", "full_outer").join(pre(region, "region"), "subject_id", "full_outer")
    none = F.array().cast("array<string>")
    top = F.coalesce(F.greatest("company_score", "route_score", "region_score"), F.lit(0.0))
    return j.select(
        "subject_id", "company_score", "route_score", "region_score", top.alias("overall_score"), risk_level(top).alias("overall_level"),
        F.array_distinct(F.concat(F.coalesce("company_advice", none), F.coalesce("route_advice", none))).alias("recommendations"),
    )


__all__ = ["company_risk", "route_risk", "region_risk", "cargo_risk", "risk_report", "days_since", "is_night"]

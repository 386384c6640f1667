"""Counts, series, overviews and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cordon.functions.geo import _c
from cordon.functions.score import lookup, pct_change, severity_value, trend_label
from cordon.operators import filters as flt
from cordon.operators.sizes import counts, mode_of, top_n
from cordon.refdata import fixed as V
from cordon.session import as_ts


def key_counts(df: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """``(dim, key, n)`` for several single keys in one pass over the rows, plus
    the grand total as dimension ``total``."""
    names = list(dims)
    base = df.select(*[c.cast("string").alias(n) for n, c in dims.items()])
    sets = [[F.col(n)] for n in names] + [[]]
    g = base.groupingSets(sets, *names).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(n).alias(f"_g_{n}") for n in names]
    )
    dim = reduce(lambda acc, n: acc.when(F.col(f"_g_{n}") == 0, n), names[1:], F.when(F.col(f"_g_{names[0]}") == 0, names[0]))
    return g.select(dim.otherwise("total").alias("dim"), F.coalesce(*names).alias("key"), "n")


def event_stats(inc: DataFrame) -> DataFrame:
    """Counts by country, type and severity, and the total."""
    return key_counts(inc, {"country": F.col("country_code"), "event_type": F.col("event_type"), "severity": F.upper("severity")})


def calendar(spark, as_of, days: int) -> DataFrame:
    """The ``days`` dates that end with the day of ``as_of``."""
    end = F.to_date(as_ts(as_of))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))


def daily_counts(inc: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Zero-filled daily series."""
    recent = inc.where(F.col("date_occurred") >= as_ts(as_of) - F.expr(f"interval {days} days"))
    n = recent.groupBy(F.to_date("date_occurred").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar(inc.sparkSession, as_of, days).join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def monday_week(ts) -> Column:
    """Year and week number, Monday first; days before the year's first Monday are week 0."""
    d = _c(ts)
    week = F.floor((F.dayofyear(d) - 1 - F.weekday(d) + 7) / 7)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def timeline(inc: DataFrame, grain: str = "day", cap: int | None = None) -> DataFrame:
    """Counts per day or week over all rows; ``cap`` counts only the newest rows."""
    src = inc.where(F.col("date_occurred").isNotNull())
    if cap:
        src = src.orderBy(F.desc("date_occurred"), F.desc("id")).limit(cap)
    period = F.date_format("date_occurred", "yyyy-MM-dd") if grain == "day" else monday_week("date_occurred")
    return src.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))


def overview_counts(inc: DataFrame, as_of) -> DataFrame:
    """Actionable incidents since today's, this week's and this month's start."""
    today = F.date_trunc("day", as_ts(as_of)).cast("timestamp_ntz")
    week = F.date_trunc("week", as_ts(as_of)).cast("timestamp_ntz")
    month = F.date_trunc("month", as_ts(as_of)).cast("timestamp_ntz")
    return (
        inc.where(flt.actionable() & (F.col("date_occurred") >= F.least(week, month)))
        .agg(
            F.count_if(F.col("date_occurred") >= today).alias("events_today"),
            F.count_if(F.col("date_occurred") >= week).alias("events_this_week"),
            F.count_if(F.col("date_occurred") >= month).alias("events_this_month"),
        )
    )


def overview(inc: DataFrame, al: DataFrame, st: DataFrame, as_of) -> dict[str, DataFrame]:
    """The dashboard front page as named tables."""
    return {
        "counts": overview_counts(inc, as_of),
        "by_severity": counts(inc.select(F.upper(F.coalesce("severity", F.lit("unknown"))).alias("severity")), ["severity"]),
        "active_alerts": al.where("is_active").agg(F.count(F.lit(1)).alias("n")),
        "agents": counts(st, ["status"]),
        "top_countries": counts(inc, ["country_code"]).orderBy(F.desc("n"), "country_code").limit(10),
        "latest": flt.page(inc, [F.desc("date_occurred"), F.desc("id")], 10),
    }


def map_payload(hotspots: DataFrame, al: DataFrame, inc: DataFrame) -> dict[str, DataFrame]:
    first = flt.alert_list(al, active=True).limit(10)
    return {
        "hotspots": flt.present_hotspots(hotspots.orderBy(F.desc("event_count"), "country_code", "region")),
        "alerts": first.select(
            "id", "title", F.upper(F.coalesce("severity", F.lit("medium"))).alias("severity"),
            F.try_element_at("country_codes", F.lit(1)).alias("country_code"),
        ),
        "density": counts(inc, ["country_code"]),
    }


def trend_series(inc: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Zero-filled daily counts in total, per type and for the five busiest
    countries: ``(series, key, day, n)``. Only real counts, one pass."""
    recent = inc.where(F.col("date_occurred") >= as_ts(as_of) - F.expr(f"interval {days} days"))
    per = (
        recent.groupBy(F.to_date("date_occurred").alias("day"), "event_type", "country_code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = per.select(
        "day", "n",
        F.explode(
            F.array(
                F.struct(F.lit("all").alias("series"), F.lit("all").alias("key")),
                F.struct(F.lit("event_type").alias("series"), F.col("event_type").alias("key")),
                F.struct(F.lit("country").alias("series"), F.col("country_code").alias("key")),
            )
        ).alias("s"),
    )
    series = rows.groupBy("s.series", "s.key", "day").agg(F.sum("n").alias("n"))
    busy = counts(inc, ["country_code"]).orderBy(F.desc("n"), "country_code").limit(5).select(F.col("country_code").alias("key"))
    keys = series.select("series", "key").distinct()
    keys = keys.where(F.col("series") != "country").unionByName(keys.where(F.col("series") == "country").join(busy, "key", "left_semi"))
    end = F.to_date(as_ts(as_of))
    grid = keys.withColumn("day", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    return grid.join(series, ["series", "key", "day"], "left").select("series", "key", "day", F.coalesce("n", F.lit(0)).alias("n"))


def week_over_week(inc: DataFrame, as_of, weeks: int = 12) -> DataFrame:
    """Seven-day blocks counted back from the day before ``as_of``, each against
    the block before it; block ``W{weeks}`` is the latest."""
    end = F.to_date(as_ts(as_of))
    back = F.datediff(end, F.to_date("date_occurred"))
    n = (
        inc.where((back >= 1) & (back <= 7 * (weeks + 1)))
        .groupBy(F.floor((back - 1) / 7).cast("int").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = inc.sparkSession.range(0, weeks + 1).select(F.col("id").cast("int").alias("w"))
    full = grid.join(n, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    prev = full.select((F.col("w") - 1).alias("w"), F.col("n").alias("prev_n"))
    out = full.join(prev, "w").where(F.col("w") < weeks)
    change = F.round((F.col("n") - F.col("prev_n")) / F.greatest(F.col("prev_n"), F.lit(1)) * 100, 1)
    return out.select(F.concat(F.lit("W"), (F.lit(weeks) - F.col("w")).cast("string")).alias("week"), "n", "prev_n", change.alias("change_pct"))


def financial_overview(co: DataFrame) -> DataFrame:
    """Companies at risk with flags for the bankrupt and critical lists."""
    return flt.at_risk(co).select(
        "id", "name", "country_code", F.upper("financial_status").alias("financial_status"), "risk_score",
        (F.col("financial_status") == "bankrupt").alias("recent_bankruptcy"),
        (F.col("financial_status") == "critical").alias("recent_revocation"),
    )


def payment_trend(inc: DataFrame) -> DataFrame:
    """Payment issues per month."""
    return (
        inc.where(F.col("event_type") == "payment_issue")
        .groupBy(F.date_format("date_occurred", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def alert_stats(al: DataFrame) -> DataFrame:
    """Active by severity, all by first country, totals and mean hours to resolve."""
    hours = (F.unix_micros(F.col("resolved_at").cast("timestamp")) - F.unix_micros(F.col("triggered_at").cast("timestamp"))) / 3.6e9
    sev = al.where("is_active").groupBy(F.upper(F.coalesce("severity", F.lit("medium"))).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    cc = (
        al.where(F.size("country_codes") > 0)
        .groupBy(F.element_at("country_codes", 1).alias("key"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )
    tot = al.agg(
        F.count_if("is_active").cast("double").alias("total_active"),
        F.count_if(~F.col("is_active")).cast("double").alias("total_resolved"),
        F.coalesce(F.round(F.avg(F.when(~F.col("is_active"), hours)), 1), F.lit(0.0)).alias("mean_hours"),
    )
    tot = tot.select(F.explode(F.create_map(F.lit("total_active"), "total_active", F.lit("total_resolved"), "total_resolved", F.lit("mean_hours"), "mean_hours")).alias("key", "value"))
    return (
        sev.select(F.lit("active_severity").alias("dim"), "key", "value")
        .unionByName(cc.select(F.lit("country").alias("dim"), "key", "value"))
        .unionByName(tot.select(F.lit("total").alias("dim"), "key", "value"))
    )


def agent_summary(st: DataFrame) -> DataFrame:
    """Per country: supervisor state and totals; the row without a country is the total."""
    g = st.groupingSets([[F.col("country_code")], []], "country_code").agg(
        F.count(F.lit(1)).alias("agents"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "stopped").alias("stopped"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.coalesce("events_collected_today", F.lit(0))).alias("events_today"),
    )
    sup = F.when((F.col("errors") > 0) | (F.col("running") > 0), "running").otherwise("stopped")
    return g.select(
        "country_code", lookup(V.COUNTRY_NAMES, "country_code").alias("country_name"), sup.alias("supervisor_status"),
        "agents", "running", "stopped", "errors", "events_today",
    )


def agent_health(st: DataFrame, as_of) -> DataFrame:
    """One row per agent and problem, and one ``healthy``/``unhealthy`` row each."""
    age = (F.unix_micros(as_ts(as_of).cast("timestamp")) - F.unix_micros(F.col("last_heartbeat").cast("timestamp"))) / 1e6
    stale, noisy = F.coalesce(age > 300, F.lit(False)), F.coalesce("errors_today", F.lit(0)) > 5
    bad = stale | noisy | (F.col("status") == "error")
    issue = lambda cond, name: F.when(cond, F.lit(name))
    rows = F.array_compact(
        F.array(issue(stale, "heartbeat_stale"), issue(noisy, "high_error_rate"), F.when(bad, F.lit("unhealthy")).otherwise("healthy"))
    )
    return st.select(
        "country_code", "agent_type", F.explode(rows).alias("issue"),
        F.when(stale, F.round(age / 60, 1)).alias("minutes_ago"), F.col("errors_today"),
    )


def freshness(inc: DataFrame, as_of) -> DataFrame:
    """How much arrived lately, and the health verdict."""
    now, c = as_ts(as_of), F.col("date_collected")
    n = inc.where((c >= now - F.expr("interval 24 hours")) & (c <= now)).agg(
        *[F.count_if(c >= now - F.expr(f"interval {m} minutes")).alias(f"last_{m}m") for m in (30, 60)],
        F.count(F.lit(1)).alias("last_24h"),
    )
    status = F.when(F.col("last_30m") > 0, "ok").when(F.col("last_60m") > 0, "warning").otherwise("critical")
    return n.withColumn("status", status)


def daily_digest(inc, al, hotspots, co, as_of, risk_min: float = 70.0) -> dict[str, DataFrame]:
    """The last day as named tables; ``risk_min`` is on the 0-100 scale."""
    since = as_ts(as_of) - F.expr("interval 24 hours")
    day = inc.where((F.col("date_collected") >= since) & (F.col("date_collected") <= as_ts(as_of)))
    alerts = al.where((F.col("triggered_at") >= since) & (F.col("triggered_at") <= as_ts(as_of)))
    return {
        "totals": day.agg(
            F.count(F.lit(1)).alias("total_events"), F.count_if(F.col("severity") == "critical").alias("critical_count")
        ),
        "alerts": alerts.agg(F.count(F.lit(1)).alias("alerts_count")),
        "top_events": day.orderBy(-severity_value(), "date_collected", "id")
        .select("id", "title", "severity", "country_code").limit(10),
        "hotspots": hotspots.where(F.col("last_calculated") >= since).orderBy(F.desc("event_count"), "country_code", "region").limit(5),
        "companies": co.where(F.col("risk_score") >= risk_min).orderBy(F.desc("risk_score"), "id")
        .select("id", "name", "country_code", F.round("risk_score", 2).alias("risk_score")).limit(5),
        "per_country": counts(day, ["country_code"]).orderBy(F.desc("n"), "country_code").limit(10),
    }


def summary_24h(inc: DataFrame, as_of) -> DataFrame:
    """``(dim, key, n)`` for the last day: total, thefts, types, tiers, top five countries."""
    since = as_ts(as_of) - F.expr("interval 24 hours")
    day = inc.where((F.col("date_collected") >= since) & (F.col("date_collected") <= as_ts(as_of)))
    k = key_counts(day, {"event_type": F.col("event_type"), "country": F.col("country_code"), "tier": F.col("intelligence_tier")})
    k = k.where(~((F.col("dim") == "tier") & F.col("key").isNull()))
    top = k.where(F.col("dim") == "country").orderBy(F.desc("n"), "key").limit(5)
    theft = k.where((F.col("dim") == "event_type") & F.col("key").isin(V.THEFT_TYPES)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return (
        k.where(F.col("dim") != "country").unionByName(top)
        .unionByName(theft.select(F.lit("thefts").alias("dim"), F.lit(None).cast("string").alias("key"), "n"))
    )


def place_key() -> Column:
    """Country, with the region after a slash when there is one."""
    cc = F.coalesce("country_code", F.lit("??"))
    return F.when(F.coalesce("region", F.lit("")) != "", F.concat(cc, F.lit("/"), F.col("region"))).otherwise(cc)


def exec_summary(inc: DataFrame) -> DataFrame:
    """Breakdowns, three busiest places and three companies with most official
    financial trouble: ``(dim, key, n)``."""
    base = key_counts(
        inc,
        {
            "event_type": F.col("event_type"), "country": F.coalesce("country_code", F.lit("??")),
            "severity": F.coalesce(F.upper("severity"), F.lit("UNKNOWN")), "place": place_key(),
        },
    )
    places = base.where(F.col("dim") == "place").orderBy(F.desc("n"), "key").limit(3)
    firms = (
        inc.where(F.col("event_type").isin(V.FINANCIAL_TYPES) & F.col("is_official") & F.col("company_name").isNotNull())
        .groupBy(F.col("company_name").alias("key")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "key").limit(3)
    )
    return (
        base.where(F.col("dim") != "place").unionByName(places)
        .unionByName(firms.select(F.lit("company").alias("dim"), "key", "n"))
    )


def statistics(inc: DataFrame) -> DataFrame:
    """Counts per country, type, severity, ten main sources, and mean trust (x100)."""
    k = key_counts(
        inc,
        {
            "country": F.coalesce("country_code", F.lit("??")), "event_type": F.col("event_type"),
            "severity": F.coalesce(F.upper("severity"), F.lit("UNKNOWN")), "source": F.coalesce("source_name", F.lit("unknown")),
        },
    ).select("dim", "key", F.col("n").cast("double").alias("value"))
    top = k.where(F.col("dim") == "source").orderBy(F.desc("value"), "key").limit(10)
    trust = inc.agg(F.coalesce(F.round(F.avg("trust_score"), 2), F.lit(0.0)).alias("value"))
    return k.where(F.col("dim") != "source").unionByName(top).unionByName(
        trust.select(F.lit("mean_trust").alias("dim"), F.lit(None).cast("string").alias("key"), "value")
    )


def country_blocks(inc: DataFrame, top: int = 5) -> DataFrame:
    """Busiest countries with severity mix and their five busiest regions."""
    src = inc.where(F.coalesce("country_code", F.lit("")) != "")
    best = counts(src, ["country_code"], "event_count").orderBy(F.desc("event_count"), "country_code").limit(top)
    few = src.join(best.select("country_code"), "country_code", "left_semi")
    sev = counts(few.select("country_code", F.upper(F.coalesce("severity", F.lit("medium"))).alias("s")), ["country_code", "s"], "c")
    sev = sev.groupBy("country_code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "c")))).alias("severity_mix"))
    reg = counts(few.where(F.coalesce("region", F.lit("")) != ""), ["country_code", "region"], "c")
    reg = top_n(reg, ["country_code"], [F.desc("c"), F.asc("region")], 5)
    reg = reg.groupBy("country_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "region"))), lambda x: x["region"]).alias("top_regions"))
    return best.join(sev, "country_code", "left").join(reg, "country_code", "left")


def country_summary(inc: DataFrame, hotspot_counts: DataFrame | None = None) -> DataFrame:
    """Per country: events, main type, severity score, number of hotspots."""
    src = inc.withColumn("country_code", F.upper(F.coalesce("country_code", F.lit("??"))))
    per = src.groupBy("country_code", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(severity_value()).alias("s"))
    out = per.groupBy("country_code").agg(
        F.sum("n").alias("event_count"),
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("top_type"),
        F.least(F.lit(100.0), F.round(F.sum("s") * 2.5, 1)).alias("risk_score"),
    ).withColumn("country_name", F.coalesce(lookup(V.COUNTRY_NAMES, "country_code"), F.col("country_code")))
    if hotspot_counts is None:
        return out.withColumn("hotspot_count", F.lit(0).cast("bigint"))
    return out.join(hotspot_counts, "country_code", "left").withColumn("hotspot_count", F.coalesce("hotspot_count", F.lit(0)))


def corridor_risk(inc: DataFrame, members: DataFrame) -> DataFrame:
    """Per corridor: events, severity score, main type and three worst incidents."""
    from cordon.operators.joins import corridor_events2

    e = corridor_events2(inc, members).withColumn("_sv", severity_value())
    per = e.groupBy("corridor", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("_sv").alias("s"))
    out = per.groupBy("corridor").agg(
        F.sum("n").alias("event_count"),
        F.least(F.lit(100.0), F.round(F.sum("s") * 3.0, 1)).alias("risk_score"),
        F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("dominant_type"),
    )
    worst = top_n(e, ["corridor"], [F.desc("_sv"), F.asc("id")], 3)
    worst = worst.groupBy("corridor").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", "id", "event_type", "severity", "country_code"))), lambda x: x["id"]
        ).alias("top_incidents")
    )
    return out.join(worst, "corridor")


def tier_counts(inc: DataFrame) -> DataFrame:
    return inc.agg(
        F.count("intelligence_tier").alias("processed"),
        *[F.count_if(F.col("intelligence_tier") == t).alias(f"tier_{t}") for t in (1, 2, 3, 4)],
    )


def country_pairs(inc: DataFrame, min_events: int = 3) -> DataFrame:
    """Pairs of countries by joint number of events; pairs of counts, never of events."""
    c = counts(inc.where(F.coalesce("country_code", F.lit("")) != ""), ["country_code"])
    listed = c.agg(F.sort_array(F.collect_list(F.struct("country_code", "n"))).alias("l"))  # at most a few hundred codes
    pairs = listed.select(
        F.explode(
            F.flatten(
                F.transform(
                    "l", lambda a: F.transform(F.filter("l", lambda b: b["country_code"] > a["country_code"]),
                                               lambda b: F.struct(a.alias("a"), b.alias("b")))
                )
            )
        ).alias("p")
    )
    out = pairs.select(
        F.col("p.a.country_code").alias("country_a"), F.col("p.b.country_code").alias("country_b"),
        (F.col("p.a.n") + F.col("p.b.n")).alias("event_count"),
    )
    return out.where(F.col("event_count") >= min_events)


def heat_grid(inc: DataFrame, res: float = 0.5) -> DataFrame:
    """Events per grid cell at its centre, with intensity against the fullest."""
    src = inc.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    snap = lambda c: F.round(F.floor(F.col(c) / res) * res + res / 2, 2)
    cells = src.groupBy(snap("latitude").alias("lat"), snap("longitude").alias("lon")).agg(F.count(F.lit(1)).alias("event_count"))
    top = cells.agg(F.max("event_count").alias("_m"))
    return cells.join(F.broadcast(top)).select("lat", "lon", "event_count", F.round(F.col("event_count") / F.col("_m"), 3).alias("intensity"))


def period_trends(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """``(dim, key, current, previous, change_pct, trend, hotspot_change)`` by
    country and type; a country with three or more events counts as a hotspot."""
    dims = lambda d: key_counts(d, {"country": F.coalesce("country_code", F.lit("??")), "event_type": F.col("event_type")}).where(F.col("dim") != "total")
    c, p = dims(cur).withColumnRenamed("n", "current"), dims(prev).withColumnRenamed("n", "previous")
    out = c.join(p, ["dim", "key"], "full_outer").select(
        "dim", "key", F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("previous", F.lit(0)).alias("previous")
    )
    hot = F.when(F.col("dim") != "country", F.lit(None).cast("string")).when(
        (F.col("current") >= 3) & (F.col("previous") < 3), "new"
    ).when((F.col("current") < 3) & (F.col("previous") >= 3), "fading")
    return out.select(
        "*", pct_change("current", "previous").alias("change_pct"), trend_label("current", "previous").alias("trend"),
        hot.alias("hotspot_change"),
    )


def period_facts(inc: DataFrame) -> DataFrame:
    """One row: totals, main type and country, number of serious events."""
    per = inc.groupBy("event_type", "country_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower("severity").isin("critical", "high")).alias("h")
    )
    tot = per.agg(F.sum("n").alias("total_events"), F.count_distinct("country_code").alias("countries"), F.sum("h").alias("serious_events"))
    t = mode_of(inc, [], "event_type", "top_type", "top_type_count")
    c = mode_of(inc.where(F.col("country_code").isNotNull()), [], "country_code", "top_country", "top_country_count")
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(tot).join(one(t), "_k").join(one(c), "_k").drop("_k")


def country_facts(inc: DataFrame) -> DataFrame:
    """Per country: events, main type, busiest region."""
    src = inc.where(F.col("country_code").isNotNull())
    total = counts(src, ["country_code"], "event_count")
    t = mode_of(src, ["country_code"], "event_type", "top_type", "top_type_count")
    r = mode_of(src.where(F.coalesce("region", F.lit("")) != ""), ["country_code"], "region", "top_region", "top_region_count")
    return total.join(t, "country_code").join(r, "country_code", "left")


def running_week(inc: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Daily series with the seven-day running sum, over days, not events."""
    d = daily_counts(inc, as_of, days)  # one row per day, so one window is small
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-6, 0)
    return d.select("day", "n", F.sum("n").over(w).alias("week_sum"))

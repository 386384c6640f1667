"""Report tables for a period and a list of countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions.score import lookup, severity_value
from cordon.functions.text import shortened
from cordon.operators import correlate as corr
from cordon.operators import joins as j
from cordon.operators import stats as s
from cordon.operators import windows as w
from cordon.operators.filters import at_risk
from cordon.operators.sizes import counts, mode_of
from cordon.refdata import fixed as V
from cordon.refdata.tables import literal
from cordon.session import as_ts
from cordon.sources.ingest_rows import report_record


def _official() -> Column:
    return F.coalesce("is_official", F.lit(False))


def _trust() -> Column:
    return F.coalesce("trust_score", F.lit(0.0))


def _lines(df: DataFrame, company: Column) -> DataFrame:
    place = F.concat_ws(", ", F.nullif("city", F.lit("")), F.nullif("region", F.lit("")), "country_code")
    return df.select(
        "id", "date_occurred", F.coalesce("country_code", F.lit("??")).alias("country_code"), F.coalesce("region", F.lit("")).alias("region"), place.alias("location"),
        "event_type", F.upper("severity").alias("severity"), "description", "source_name", "source_url", "trust_score", _official().alias("is_official"),
        company.alias("company"),
    )


def confirmed(inc: DataFrame) -> DataFrame:
    """Official and trusted incidents with company names."""
    return _lines(inc.where((_trust() >= 0.8) & _official()), F.coalesce("company_name", F.lit("")))


def signals(inc: DataFrame) -> DataFrame:
    """Unconfirmed incidents; the company is only a region phrase. Official ones
    between .79 and .8 fall in neither section."""
    hit = ((_trust() >= 0.2) & (_trust() <= 0.79)) | (~_official() & (_trust() > 0))
    return _lines(inc.where(hit), F.concat(F.lit("Transport company in "), F.coalesce("region", "country_code", F.lit("??"))))


def financial(inc: DataFrame) -> DataFrame:
    """Money trouble in fixed type order; names only from official sources."""
    order = lookup({t: i for i, t in enumerate(["bankruptcy", "restructuring", "payment_issue", "license_revoked"])}, "event_type")
    e = inc.where(F.col("event_type").isin(V.FINANCIAL_TYPES))
    out = _lines(e, F.when(_official(), F.coalesce("company_name", F.lit(""))).otherwise(""))
    return out.withColumn("section", order)


def risk_map(inc: DataFrame, top: int | None = None) -> DataFrame:
    """Per country and region: events, mean severity, centre, description."""
    src = inc.withColumn("place", s.place_key())
    g = src.groupBy("place").agg(
        F.count(F.lit(1)).alias("event_count"), F.round(F.avg(severity_value()), 2).alias("severity_avg"),
        F.round(F.avg("latitude"), 4).alias("latitude"), F.round(F.avg("longitude"), 4).alias("longitude"),
    )
    if top:
        g = g.orderBy(F.desc("event_count"), "place").limit(top)
    g = g.join(mode_of(src, ["place"], "event_type", "top_type"), "place")
    line = F.concat(F.col("event_count").cast("string"), F.lit(" incidents in "), "place", F.lit(" (primary type: "), "top_type", F.lit(", avg severity: "), F.col("severity_avg").cast("string"), F.lit(")"))
    return g.withColumn("description", line)


def by_country(inc: DataFrame) -> DataFrame:
    """Per country, counts and the type and severity maps."""
    src = inc.withColumn("country_code", F.coalesce("country_code", F.lit("unknown")))
    per = counts(src.select("country_code", "event_type", F.upper(F.coalesce("severity", F.lit("medium"))).alias("severity")), ["country_code", "event_type", "severity"])
    def as_map(col, out):
        one = per.groupBy("country_code", col).agg(F.sum("n").alias("n"))
        return one.groupBy("country_code").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(col, "n")))).alias(out))
    total = per.groupBy("country_code").agg(F.sum("n").alias("n"))
    return total.join(as_map("event_type", "types"), "country_code").join(as_map("severity", "severities"), "country_code")


def recommendations(inc: DataFrame, segs: DataFrame) -> DataFrame:
    """Advice by rule: ``(rule, subject, n)``."""
    theft = inc.where(F.col("event_type").isin(V.THEFT_TYPES))
    places = counts(theft.select(s.place_key().alias("subject")), ["subject"]).orderBy(F.desc("n"), "subject").limit(3).where(F.col("n") >= 3)
    fuel = inc.where(F.col("event_type") == "theft_fuel").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("country_code")), ", ").alias("subject")).where(F.col("n") >= 5)
    firms = inc.where(F.col("event_type").isin("bankruptcy", "restructuring", "payment_issue") & (F.coalesce("company_name", F.lit("")) != ""))
    firms = counts(firms.select(F.col("company_name").alias("subject")), ["subject"]).orderBy(F.desc("n"), "subject").limit(3).where(F.col("n") >= 2)
    route = corr.cross_country(inc, segs).select(F.col("corridor").alias("subject"), F.col("event_count").alias("n"))
    times = w.time_patterns(inc).select(F.concat_ws(" ", "day_of_week", "time_window").alias("subject"), F.col("event_count").alias("n"))
    rows = [("night_security", places), ("fuel_theft", fuel), ("company_diligence", firms), ("corridor_monitoring", route), ("schedule", times)]
    return reduce(DataFrame.unionByName, [d.select(F.lit(r).alias("rule"), "subject", "n") for r, d in rows])


# --- fixed values: alert actions ---------------------------------------------
ACTIONS = [
    ("theft", 0, "Notify fleet management and security team immediately."), ("theft", 1, "File a police report if not already done."),
    ("theft", 2, "Review security procedures for the affected route/parking area."),
    ("theft_critical", 3, "Consider temporary route change for high-value cargo."),
    ("financial", 0, "Review outstanding contracts and receivables with the affected company."),
    ("financial", 1, "Assess alternative partners/subcontractors for continuity."), ("financial", 2, "Monitor official registry for further proceedings."),
    ("license", 0, "Cease any ongoing cooperation with the affected entity immediately."), ("license", 1, "Verify subcontractor compliance and license status."),
    ("route", 0, "Plan alternative routes for affected corridors."), ("route", 1, "Notify dispatchers and drivers of the disruption."),
    ("strike", 0, "Monitor strike developments and negotiate contingency plans."), ("strike", 1, "Consider pre-positioning inventory before disruption worsens."),
    ("other", 0, "Review the incident details and assess impact on operations."), ("other", 1, "Monitor for further developments."),
]


def alert_actions(al: DataFrame) -> DataFrame:
    """One row per alert ``(id, event_type, severity, related_event_ids)`` and action."""
    ref = literal(al.sparkSession, ACTIONS, "family string, step int, action string")
    e, sv = F.coalesce("event_type", F.lit("")), F.upper(F.coalesce("severity", F.lit("medium")))
    fam = (
        F.when(e.startswith("theft"), "theft").when(e.isin("bankruptcy", "restructuring", "payment_issue"), "financial").when(e == "license_revoked", "license")
        .when(e.isin("route_closure", "delay"), "route").when(e == "strike", "strike").otherwise("other")
    )
    families = F.array_compact(F.array(fam, F.when((fam == "theft") & (sv == "CRITICAL"), "theft_critical")))
    out = al.select("id", F.explode(families).alias("family")).join(ref, "family").select("id", "step", "action")
    n = F.size(F.coalesce("related_event_ids", F.array()))
    note = al.where(n > 0).select("id", F.lit(9).alias("step"), F.format_string("Note: %d related event(s) detected. This may indicate a broader pattern.", n).alias("action"))
    return out.unionByName(note)


def message_text(inc: DataFrame, description_chars: int | None = None) -> DataFrame:
    """Readable channel message per incident; missing parts leave no line. The description is cut only to a limit that is given."""
    head = F.coalesce(lookup(V.MESSAGE_LABELS, "event_type"), F.upper(F.translate("event_type", "_", " ")))
    name = F.coalesce(lookup(V.COUNTRY_NAMES, "country_code"), F.col("country_code"))
    mark = F.when(F.coalesce("intelligence_tier", F.lit(3)) == 1, "\U0001f6a8 ").otherwise("⚠️ ")
    opt = lambda label, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(label), c))
    place = F.coalesce("location_detail", "city", "region")
    money = F.when(F.coalesce("financial_impact_eur", F.lit(0.0)) != 0, F.concat(F.lit("\U0001f4b0 €"), F.format_number("financial_impact_eur", 0)))
    text = F.concat_ws(
        "\n", F.concat(mark, F.lit("**"), head, F.lit("** | "), name, F.lit("\n")), opt("\U0001f4cd ", place),
        opt("\U0001f4c5 ", F.date_format(F.coalesce("date_occurred", "date_collected"), "dd.MM.yyyy HH:mm")), opt("\U0001f4dd ", shortened("description", description_chars)), money,
        opt("\U0001f50d MO: ", F.col("modus_operandi")), opt("\U0001f4e6 Cargo: ", F.col("cargo_type")), opt("⚠️ Source: ", F.col("source_name")),
    )
    return inc.select("id", text.alias("message"))


def report_tables(inc: DataFrame, co: DataFrame, kind: str, start: str, end: str, countries: list[str] | None = None) -> dict[str, DataFrame]:
    """The named tables of one report. The period's rows are scanned through plain
    filters on date and country, which reach the files; nothing is collected."""
    ccs = [c.upper() for c in countries or []]
    src = inc.where(F.col("country_code").isin(ccs)) if ccs else inc
    now = src.where((F.col("date_occurred") >= as_ts(start)) & (F.col("date_occurred") < as_ts(end)))
    span = F.expr(f"timestamp_ntz'{end}' - timestamp_ntz'{start}'")
    before = src.where((F.col("date_occurred") >= as_ts(start) - span) & (F.col("date_occurred") < as_ts(start)))
    segs = j.segments(inc.sparkSession)
    out = {
        "record": report_record(now, kind, start[:10], end[:10], ccs), "confirmed": confirmed(now), "signals": signals(now), "financial": financial(now),
        "risk_map": risk_map(now), "trends": s.period_trends(now, before), "by_country": by_country(now), "summary": s.exec_summary(now),
        "statistics": s.statistics(now), "recommendations": recommendations(now, segs), "companies_at_risk": at_risk(co, ccs, 20),
    }
    if kind in ("sales", "client"):
        out["country_blocks"] = s.country_blocks(now)
        out["country_pairs"] = s.country_pairs(now)
    return out

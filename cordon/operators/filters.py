"""Lists, look-ups and projections over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cordon.functions.match import any_of
from cordon.functions.phrases import any_of_language, in_terms, listed
from cordon.functions.text import host_of
from cordon.operators.sizes import first_by, top_n
from cordon.refdata import fixed as V
from cordon.session import as_ts

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def actionable() -> Column:
    """Tier one or two, or not tiered yet."""
    return (F.col("intelligence_tier") <= 2) | F.col("intelligence_tier").isNull()


def event_filter(
    inc: DataFrame, country=None, event_type=None, severity=None, date_from=None, date_to=None,
    trust_min: float = 0.0, verified=None, tier=None, tier_max=None, include_low: bool = False,
) -> DataFrame:
    """Plain predicates, so they all reach the file scan."""
    out = inc
    if country:
        out = out.where(F.col("country_code") == country.upper())
    if event_type:
        out = out.where(F.col("event_type") == event_type)
    if severity:
        out = out.where(F.col("severity") == severity.lower())
    if date_from:
        out = out.where(F.col("date_occurred") >= as_ts(date_from))
    if date_to:
        out = out.where(F.col("date_occurred") <= as_ts(date_to))
    if trust_min > 0:
        out = out.where(F.col("trust_score") >= trust_min)
    if verified is not None:
        out = out.where(F.col("is_verified") == verified)
    if tier is not None:
        out = out.where(F.col("intelligence_tier") == tier)
    elif tier_max is not None:
        out = out.where(F.col("intelligence_tier") <= tier_max)
    elif not include_low:
        out = out.where(actionable())
    return out


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in order; each task keeps only offset + limit rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def event_list(inc: DataFrame, limit: int = 50, offset: int = 0, **flt) -> DataFrame:
    return page(event_filter(inc, **flt), [F.desc("date_occurred"), F.desc("id")], limit, offset)


def event_total(inc: DataFrame, **flt) -> DataFrame:
    return event_filter(inc, **flt).agg(F.count(F.lit(1)).alias("total"))


def company_list(co: DataFrame, country=None, company_type=None, status=None, risk_min=None, limit: int = 50, offset: int = 0) -> DataFrame:
    out = co
    if country:
        out = out.where(F.col("country_code") == country.upper())
    if company_type:
        out = out.where(F.col("company_type") == company_type)
    if status:
        out = out.where(F.col("financial_status") == status.lower())
    if risk_min is not None:
        out = out.where(F.col("risk_score") >= risk_min)
    return page(out, [F.desc("risk_score"), F.asc("id")], limit, offset)


def at_risk(co: DataFrame, countries: list[str] | None = None, limit: int | None = None) -> DataFrame:
    out = co.where(F.col("financial_status").isin(V.AT_RISK_STATUSES))
    if countries:
        out = out.where(F.col("country_code").isin([c.upper() for c in countries]))
    out = out.orderBy(F.desc("risk_score"), F.asc("id"))
    return out.limit(limit) if limit else out


def alert_list(al: DataFrame, active=None, severity=None, alert_type=None, country=None) -> DataFrame:
    out = al
    if active is not None:
        out = out.where(F.col("is_active") == active)
    if severity:
        out = out.where(F.col("severity") == severity.lower())
    if alert_type:
        out = out.where(F.col("alert_type") == alert_type)
    if country:
        out = out.where(F.array_contains("country_codes", country.upper()))
    return out.orderBy(F.desc("triggered_at"), F.asc("id"))


def report_list(r: DataFrame, report_type=None, status=None, date_from=None, date_to=None) -> DataFrame:
    """Date bounds compare as ISO text."""
    out = r
    if report_type:
        out = out.where(F.col("report_type") == report_type)
    if status:
        out = out.where(F.col("status") == status)
    created = F.date_format("created_at", ISO)
    if date_from:
        out = out.where(created >= date_from)
    if date_to:
        out = out.where(created <= date_to)
    return out.orderBy(F.desc("created_at"), F.asc("id"))


def subscriber_list(s: DataFrame, active_only: bool = True) -> DataFrame:
    out = s.where("is_active") if active_only else s
    return out.orderBy("company_name", "id")


def by_id(df: DataFrame, value) -> DataFrame:
    return df.where(F.col("id") == value)


def company_history(inc: DataFrame, company_id, n: int | None = None) -> DataFrame:
    out = inc.where(F.col("company_id") == company_id).orderBy(F.desc("date_occurred"), F.desc("id"))
    return out.limit(n) if n else out


def latest_per_company(df: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows of every company at once."""
    return top_n(df.where(F.col("company_id").isNotNull()), ["company_id"], [F.desc("date_occurred"), F.desc("id")], n)


# --- response projections ----------------------------------------------------

def _iso(c: str) -> Column:
    return F.date_format(c, ISO)


def present_events(df: DataFrame) -> DataFrame:
    place = F.struct(
        F.col("country_code").alias("country"), "region", "city", "latitude", "longitude"
    )
    return df.select(
        "id", "event_type", F.upper(F.coalesce("severity", F.lit("medium"))).alias("severity"), "title", "description",
        "country_code",
        F.when(F.coalesce("region", F.lit("")).__ne__("") | F.coalesce("city", F.lit("")).__ne__(""), place).alias("location"),
        _iso("date_occurred").alias("date"), F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"),
        F.coalesce("is_official", F.lit(False)).alias("is_official"), "is_verified", "source_name", "source_url",
        "company_name", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "financial_impact_eur",
        "cargo_type", "modus_operandi", "location_detail", "language", "intelligence_tier", "intelligence_category",
    )


def present_companies(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "name", "country_code", "company_type",
        F.upper(F.coalesce("financial_status", F.lit("unknown"))).alias("financial_status"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
    )


def present_alerts(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "alert_type", F.upper(F.coalesce("severity", F.lit("medium"))).alias("severity"), "title",
        F.try_element_at("country_codes", F.lit(1)).alias("country_code"), "is_active",
        _iso("triggered_at").alias("created_at"), _iso("resolved_at").alias("resolved_at"),
        F.coalesce("related_event_ids", F.array()).alias("related_event_ids"),
    )


def present_hotspots(df: DataFrame) -> DataFrame:
    return df.select(
        "latitude", "longitude", "event_count", F.upper(F.coalesce("severity", F.lit("medium"))).alias("severity"),
        F.col("hotspot_type").alias("event_type"), "radius_km", F.col("region").alias("label"),
    )


def agent_log(st: DataFrame, as_of, country=None, agent_type=None, level=None, limit: int = 100) -> DataFrame:
    """Log lines derived from agent state: errors, and running agents with events."""
    ts = F.date_format(F.coalesce("last_heartbeat", as_ts(as_of)), ISO).alias("timestamp")
    errors = st.where((F.col("status") == "error") & F.col("last_error").isNotNull() & (F.col("last_error") != "")).select(
        ts, "country_code", "agent_type", F.lit("ERROR").alias("level"), F.col("last_error").alias("message")
    )
    infos = st.where((F.col("status") == "running") & (F.coalesce("events_collected_today", F.lit(0)) > 0)).select(
        ts, "country_code", "agent_type", F.lit("INFO").alias("level"),
        F.format_string("Collected %d events today.", F.col("events_collected_today")).alias("message"),
    )
    out = errors.unionByName(infos)
    if country:
        out = out.where(F.col("country_code") == country.upper())
    if agent_type:
        out = out.where(F.col("agent_type") == agent_type)
    if level:
        out = out.where(F.col("level") == level.upper())
    return out.orderBy(F.desc("timestamp"), "country_code", "agent_type").limit(limit)


def change_feed(al: DataFrame, inc: DataFrame, since, countries: list[str] | None = None, limit: int = 200) -> DataFrame:
    """Alerts since a moment, and the newest events since then, as one feed."""
    a = al.where(F.col("triggered_at") >= as_ts(since))
    e = inc.where(F.col("date_occurred") >= as_ts(since))
    if countries:
        ccs = [c.upper() for c in countries]
        a = a.where(F.arrays_overlap("country_codes", F.array(*map(F.lit, ccs))))
        e = e.where(F.col("country_code").isin(ccs))
    e = e.orderBy(F.desc("date_occurred"), F.desc("id")).limit(limit)
    cols = lambda kind, typ, at: [
        F.lit(kind).alias("kind"), F.col("id"), F.col(typ).alias("type"), F.col("severity"), F.col("title"), F.col(at).alias("at"),
    ]
    return a.select(*cols("alert", "alert_type", "triggered_at")).unionByName(e.select(*cols("event", "event_type", "date_occurred")))


# --- relevance and routing ---------------------------------------------------

def url_policy(df: DataFrame, blocked: list[str] | None = None, allowed: list[str] | None = None, url: str = "source_url") -> DataFrame:
    """Adds ``host`` and ``url_verdict``: blocked, allowed, login, paywall or ok.
    The lists are short and fixed, so they are set predicates, not joins."""
    allowed = V.ALLOWED_HOSTS if allowed is None else allowed
    h = F.col("host")
    verdict = F.when(h.isin(blocked or []), "blocked") if blocked else F.when(F.lit(False), "blocked")
    verdict = verdict.when(h.isin(allowed), "allowed").when(h.isin(V.LOGIN_HOSTS), "login").when(h.isin(V.PAYWALL_HOSTS), "paywall")
    return df.withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("url_verdict", verdict.otherwise("ok"))


def is_transport(df: DataFrame, vehicle_terms: DataFrame, event_terms: DataFrame, text: Column, lang="language", out: str = "is_transport") -> DataFrame:
    """A vehicle word and an event word; languages without lists use English."""
    code = lang if isinstance(lang, Column) else F.col(lang)
    d = in_terms(in_terms(df, vehicle_terms, text, "_vw"), event_terms, text, "_ew")
    both = any_of_language("_vw", listed(vehicle_terms, code, "en")) & any_of_language("_ew", listed(event_terms, code, "en"))
    return d.withColumn(out, both).drop("_vw", "_ew")


def has_event_word(df: DataFrame, event_terms: DataFrame, text: Column, lang="language", out: str = "has_event_word") -> DataFrame:
    """An event word in the row's own language or in English."""
    code = lang if isinstance(lang, Column) else F.col(lang)
    d = in_terms(df, event_terms, text, "_ew")
    return d.withColumn(out, any_of_language("_ew", code) | any_of_language("_ew", F.lit("en"))).drop("_ew")


def is_road_alert(df: DataFrame, terms: DataFrame, text: Column, lang="language", out: str = "is_road_alert") -> DataFrame:
    code = lang if isinstance(lang, Column) else F.col(lang)
    return in_terms(df, terms, text, "_rw").withColumn(out, any_of_language("_rw", listed(terms, code, "en"))).drop("_rw")


def matches_any(text: Column, keywords: list[str]) -> Column:
    """Explicit keyword list instead of the dictionaries."""
    return any_of(text, keywords)


def route_streams(msgs: DataFrame, vehicle_terms, event_terms, road_terms, text: Column, lang="language", trusted: Column | None = None) -> DataFrame:
    """Flags for the incident and road-alert streams; trusted channels need only
    an event word. Rows for neither stream are dropped."""
    d = is_transport(msgs, vehicle_terms, event_terms, text, lang, "stream_incident")
    if trusted is not None:
        d = has_event_word(d, event_terms, text, lang, "_ev")
        d = d.withColumn("stream_incident", F.col("stream_incident") | (trusted & F.col("_ev"))).drop("_ev")
    d = is_road_alert(d, road_terms, text, lang, "stream_road")
    return d.where(F.col("stream_incident") | F.col("stream_road"))


def route_channels(inc: DataFrame, country_channels: list[str]) -> DataFrame:
    """One row per incident and target channel."""
    m = F.create_map(*[F.lit(x) for kv in V.CHANNEL_OF_TYPE.items() for x in kv])
    parking = (F.col("event_type") == "damage") & F.coalesce(F.col("intelligence_category"), F.lit("")).isin("curtain_slashing", "dangerous_parking")
    topic = F.coalesce(F.try_element_at(m, F.col("event_type")), F.when(parking, "unsafe-parkings"), F.lit("road-warnings"))
    own = F.concat(F.lit("country-"), F.lower(F.coalesce("country_code", F.lit(""))))
    place = F.when(own.isin(country_channels), own).otherwise("country-other")
    return inc.withColumn("channel", F.explode(F.array_distinct(F.array(topic, place))))


def screen_sources(cand: DataFrame, known: DataFrame, min_members: int = 50) -> DataFrame:
    """New channels worth adding: large enough, not known by handle, first of each
    handle (or title when private), split public/private."""
    handle = F.lower(F.coalesce("username", F.lit("")))
    big = cand.where(F.coalesce("participants", F.lit(0)) >= min_members).withColumn("_h", handle)
    k = known.select(F.lower("username").alias("_h")).where(F.col("_h") != "").distinct()
    fresh = big.join(k, "_h", "left_anti")
    key = F.when(F.col("_h") != "", F.concat(F.lit("@"), "_h")).otherwise(F.lower(F.coalesce("title", F.lit(""))))
    fresh = fresh.withColumn("_key", key)
    return first_by(fresh, ["_key"], [F.asc("seen_order")]).withColumn(
        "visibility", F.when(F.col("_h") != "", "public").otherwise("private")
    ).drop("_h", "_key")


def monitored(msgs: DataFrame, cfg: DataFrame) -> DataFrame:
    """Messages of people, with text, in watched guilds and channels. A guild row
    with no channel list watches all of its channels."""
    m = msgs.where(~F.coalesce("is_bot", F.lit(False)) & (F.coalesce("text", F.lit("")) != "") & F.col("guild_id").isNotNull())
    c = cfg.select("guild_id", F.transform(F.coalesce("channels", F.array().cast("array<string>")), lambda x: F.lower(x)).alias("_ch"), F.col("language").alias("guild_language"))
    out = m.join(c, "guild_id")
    return out.where((F.size("_ch") == 0) | F.array_contains("_ch", F.lower("channel"))).drop("_ch")

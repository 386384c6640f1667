"""Decay, levels, bands and small score tables as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cordon.refdata import fixed as V
from cordon.session import as_ts, micros

DAY_US = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict, key, default=None) -> Column:
    """Value of a small fixed table, or the default."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, _c(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def days_since(ts, as_of) -> Column:
    """Whole days elapsed, rounded down (negative for the future)."""
    return F.floor((micros(as_ts(as_of)) - micros(_c(ts))) / F.lit(DAY_US))


def decay(ts, as_of) -> Column:
    d = days_since(ts, as_of)
    return F.when(d.isNull(), 0.5).when(d <= 30, 1.0).when(d <= 90, 0.75).when(d <= 180, 0.5).otherwise(0.25)


def weight(event_type="event_type") -> Column:
    return lookup(V.EVENT_WEIGHTS, event_type, 2.0)


def severity_value(severity="severity") -> Column:
    """0-4; unknown or missing counts as low."""
    return lookup(V.SEVERITY_RANK, F.lower(_c(severity)), 1)


def risk_level(score) -> Column:
    s = _c(score)
    return F.when(s >= 80, "CRITICAL").when(s >= 60, "HIGH").when(s >= 40, "MEDIUM").when(s >= 20, "LOW").otherwise("MINIMAL")


def check_level(score) -> Column:
    s = _c(score)
    return F.when(s >= 70, "critical").when(s >= 40, "high").when(s >= 20, "medium").otherwise("low")


def peak_band(hour) -> Column:
    h = _c(hour)
    return (
        F.when((h >= 22) | (h < 5), "22:00-05:00 (night)")
        .when(h < 10, "06:00-10:00 (morning)")
        .when(h < 16, "10:00-16:00 (daytime)")
        .otherwise("16:00-22:00 (evening)")
    )


def hour_window(ts) -> Column:
    """Pattern band of an hour; 04-06 belongs to none."""
    h = F.hour(_c(ts))
    return (
        F.when((h >= 22) | (h < 4), "night_22_04")
        .when((h >= 6) & (h < 10), "morning_06_10")
        .when((h >= 10) & (h < 16), "day_10_16")
        .when((h >= 16) & (h < 22), "evening_16_22")
    )


def severity_of(event_type, text, impact) -> Column:
    """Severity rule by type, money thresholds and strike scale."""
    from cordon.functions.match import any_of

    t, money = _c(event_type), F.coalesce(_c(impact), F.lit(0.0))
    return (
        F.when(t.isin("theft_cargo", "theft_vehicle") & (money > 50_000), "critical")
        .when((t == "bankruptcy") & (money > 1_000_000), "critical")
        .when(t.isin("theft_cargo", "theft_vehicle", "bankruptcy", "license_revoked"), "high")
        .when((t == "strike") & any_of(_c(text), V.STRIKE_SCALE), "high")
        .when(t.isin("strike", "theft_fuel", "damage", "payment_issue", "restructuring", "route_closure"), "medium")
        .when(t == "delay", "low")
        .otherwise("info")
    )


def confidence(kind, events, countries=None) -> Column:
    """0.3 plus a bonus for the number of events plus one for the kind."""
    n, k = _c(events), _c(kind)
    c = _c(countries) if countries is not None else F.lit(0)
    count_bonus = F.when(n >= 10, 0.35).when(n >= 5, 0.25).when(n >= 3, 0.15).otherwise(0.05)
    kind_bonus = (
        F.when(k == "SAME_LOCATION", 0.15)
        .when(k.isin("SAME_COMPANY", "SAME_TIME_PATTERN"), 0.10)
        .when(k == "FINANCIAL_OPERATIONAL", 0.20)
        .when(k == "CROSS_COUNTRY_ROUTE", 0.10 + F.least(F.lit(0.15), c * 0.05))
        .otherwise(0.0)
    )
    return F.least(F.lit(1.0), F.round(F.lit(0.3) + count_bonus + kind_bonus, 2))


def trend_label(cur, prev) -> Column:
    c, p = _c(cur), _c(prev)
    pct = (c - p) / F.nullif(p, F.lit(0)) * 100
    return (
        F.when(p == 0, F.when(c > 0, "new").otherwise("stable"))
        .when(pct > 15, "rising")
        .when(pct < -15, "declining")
        .otherwise("stable")
    )


def pct_change(cur, prev) -> Column:
    c, p = _c(cur), _c(prev)
    return F.when(p == 0, F.when(c > 0, 100.0).otherwise(0.0)).otherwise(
        F.round((c - p) / F.nullif(p, F.lit(0)) * 100, 1)
    )

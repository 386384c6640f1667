"""The driver's tables seen as the incident store. Integer arithmetic and short
lists only, so the DuckDB side can derive the very same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.operators.sizes import spread
from cordon.session import pin_utc

AS_OF = "2024-01-31 00:00:00"
TYPES = "theft_cargo theft_fuel theft_vehicle damage delay strike payment_issue bankruptcy restructuring license_revoked route_closure other".split()
CCS = "PL DE FR NL AT CZ RO HU IT ES".split()
CITIES = "Warszawa Dresden Lyon Rotterdam Graz Brno Sibiu Gyor Milano Barcelona".split()
LANGS = "pl de fr nl de cs ro hu it es".split()
ROADS = "A0 A1 A2 A3 A4 A5 A7 A9 D1 M1 E30 E40".split()
TAGS1 = "nocna autostrada parking granica paliwo".split()
TAGS2 = "elektronika metale debt_registry".split()
CATEGORIES = "cargo_theft insolvency fraud curtain_slashing dangerous_parking general_news".split()
NOTES = ["Payment overdue for invoices", "Driver left the company", "Court case about the license",
         "Cargo stolen from a parked trailer, EUR 12,500 lost", "Night theft at rest area on A2"]
STATUSES = "healthy warning critical bankrupt restructuring unknown".split()
FIN_TYPES = "bankruptcy_filing restructuring payment_delay license_revoked license_suspended ownership_change address_change debt_registered debt_removed".split()
SOURCE_TYPES = "police news forum financial telegram".split()
TIERS = "basic premium_alerts enterprise_api reports_only".split()
CARGO = "electronics fuel food metals".split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    pin_utc(spark)
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def pick(words: list[str], index: str) -> str:
    items = ", ".join(f"'{w}'" for w in words)
    return f"element_at(array({items}), cast({index} as int) + 1)"


def name9(prefix: str, num: str) -> str:
    return f"concat('{prefix}#', lpad(cast({num} as string), 9, '0'))"


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr(
        "*", "cast((user_id * 5 + event_id % 3) % 12 as int) as ty", "cast(user_id % 10 as int) as c",
        "case when event_id % 3 = 0 then value * 1000 end as money",
    )
    t = pick(TYPES, "ty")
    out = e.selectExpr(
        "event_id as id", f"{t} as event_type", "ts as date_occurred", "ts + make_dt_interval(0, 0, cast(event_id % 120 as int), 0) as date_collected",
        f"{pick(CCS, 'c')} as country_code",
        f"case when event_id % 11 <> 0 then concat({pick(CCS, 'c')}, '-R', cast(user_id % 3 as string)) end as region",
        f"case when event_id % 4 = 1 then {pick(CITIES, 'c')} end as city",
        "36 + (user_id * 37 % 61) * 0.5D + (event_id % 7) * 0.02D as latitude",
        "-9 + (user_id * 53 % 97) * 0.5D + (event_id % 5) * 0.02D as longitude",
        f"case when event_id % 4 <> 0 then {pick(ROADS, 'event_id % 12')} end as road",
        "user_id % 20 as source_id", "user_id as company_id", f"{name9('Customer', 'user_id')} as company_name",
        f"{name9('Supplier', 'user_id % 20')} as source_name", f"{pick(SOURCE_TYPES, 'user_id % 5')} as source_type",
        "((event_id % 20) + 1) / 20.0D as trust_score", "(user_id % 20) % 3 = 0 as is_official", "event_id % 2 = 0 as is_verified",
        "money as financial_impact_eur",
        f"case when event_id % 4 = 0 then concat('Report on ', {name9('Customer', '(user_id * 7 + event_id % 3) % 150')}) else concat('Incident ', cast(event_id as string), ' in ', {pick(CCS, 'c')}) end as title",
        f"case when event_id % 9 < 5 then {pick(NOTES, 'least(event_id % 9, 4)')} else concat('Routine note ', cast(event_id % 13 as string)) end as description",
        "case when event_id % 50 <> 0 then concat('https://n.example.org/a/', cast(event_id - case when event_id % 7 = 1 then 1 else 0 end as string)) end as source_url",
        f"{pick(LANGS, 'c')} as language", f"array({pick(TAGS1, 'event_id % 5')}, {pick(TAGS2, 'user_id % 3')}) as tags",
        "nullif(cast(event_id % 5 as int), 0) as intelligence_tier", f"{pick(CATEGORIES, 'event_id % 6')} as intelligence_category",
        f"case when event_id % 3 = 1 then {pick(CARGO, 'event_id % 4')} end as cargo_type",
        "case when event_id % 13 = 0 then 'fuel_theft' end as modus_operandi",
        "case when event_id % 8 = 0 then concat('km ', cast(event_id % 300 as string)) end as location_detail",
        f"""case when {t} in ('theft_cargo', 'theft_vehicle') and money > 50000 then 'critical'
             when {t} in ('theft_cargo', 'theft_vehicle', 'bankruptcy', 'license_revoked') then 'high'
             when {t} in ('strike', 'theft_fuel', 'damage', 'payment_issue', 'restructuring', 'route_closure') then 'medium'
             when {t} = 'delay' then 'low' else 'info' end as severity""",
    )
    return out


def companies(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "c_name as name", "lower(c_mktsegment) as company_type", f"{pick(CCS, 'c_nationkey % 10')} as country_code",
        f"{pick(STATUSES, 'c_custkey % 6')} as financial_status", "round(abs(c_acctbal) % 100, 2) as risk_score",
        f"concat({pick(CCS, 'c_nationkey % 10')}, cast(c_custkey as string)) as tax_id",
    )


def financials(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as company_id", "o_orderdate as date_occurred", "o_totalprice as amount_eur",
        f"{pick(FIN_TYPES, 'o_orderkey % 9')} as event_type", "o_orderpriority as description",
    )


def sources(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey as id", "s_name as name", f"{pick(SOURCE_TYPES, 's_suppkey % 5')} as source_type", "s_suppkey % 3 = 0 as is_official",
        f"{pick(CCS, 's_nationkey % 10')} as country_code", "((s_suppkey % 10) + 1) / 10.0D as trust_score",
    )


def alerts(spark, sf) -> DataFrame:
    """One alert per critical or high incident."""
    i = incidents(spark, sf).where("severity in ('critical', 'high')")
    return i.selectExpr(
        "id", "case when id % 2 = 0 then 'theft_spike' else 'company_risk' end as alert_type",
        "case when severity = 'critical' then 'critical' when id % 4 = 0 then 'medium' else 'high' end as severity",
        "concat('Alert ', cast(id as string)) as title",
        f"case when id % 7 = 0 then array() else array(country_code, {pick(CCS, 'id % 10')}) end as country_codes", "region",
        "id % 3 > 0 as is_active", "date_collected as triggered_at",
        "case when id % 3 = 0 then date_collected + make_dt_interval(0, cast(id % 48 as int), 0, 0) end as resolved_at",
        "array(id, id + 1, id + 2) as related_event_ids",
    )


def stored_hotspots(spark, sf) -> DataFrame:
    return incidents(spark, sf).where("region is not null").groupBy("country_code", "region").agg(
        *[F.expr(e) for e in (
            "round(avg(latitude), 4) as latitude", "round(avg(longitude), 4) as longitude", "count(*) as event_count",
            "max(date_collected) as last_calculated",
        )]
    ).selectExpr(
        "*", "25.0D as radius_km", "'theft_cargo' as hotspot_type", "case when event_count % 2 = 0 then 'low' else 'medium' end as severity",
        "'stable' as trend",
    )


def agent_status(spark, sf) -> DataFrame:


    g = incidents(spark, sf).groupBy("country_code", F.col("source_type").alias("agent_type")).agg(
        F.expr("count(*) as n"), F.expr("max(date_occurred) as last_heartbeat"), F.expr("count_if(severity = 'info') as bad")
    )
    return g.selectExpr(
        "country_code", "agent_type", "case n % 3 when 0 then 'running' when 1 then 'error' else 'stopped' end as status", "last_heartbeat",
        "n as events_collected_today", "bad as errors_today", "case when n % 3 = 1 then concat('failed after ', cast(n as string)) end as last_error",
    )


def subscribers(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey as id", "s_name as company_name", f"{pick(TIERS, 's_suppkey % 4')} as subscription_tier", "s_suppkey % 5 > 0 as is_active",
        f"case when s_suppkey % 6 = 1 then array() else array({pick(CCS, 's_nationkey % 10')}, {pick(CCS, '(s_suppkey * 3) % 10')}) end as subscribed_countries",
    )


def reports(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as id", "case o_orderkey % 3 when 0 then 'biweekly' when 1 then 'monthly' else 'sales' end as report_type",
        "case o_orderstatus when 'F' then 'generated' else 'draft' end as status", "o_orderdate as created_at",
        f"case when o_orderkey % 10 = 0 then array() else array({pick(CCS, 'o_custkey % 10')}) end as countries",
    )


def requests(spark, sf) -> DataFrame:
    """One check request per customer: its exact name, country sometimes wrong."""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey as req_id", "case when c_custkey % 10 = 9 then concat('Unknown ', c_name) else substring(c_name, 1) end as name",
        f"case when c_custkey % 4 = 0 then {pick(CCS, '(c_nationkey + 1) % 10')} else {pick(CCS, 'c_nationkey % 10')} end as country_code",
        f"case when c_custkey % 3 = 0 then concat({pick(CCS, 'c_nationkey % 10')}, cast(c_custkey as string)) end as vat_number",
    )


def vat_table(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        f"{pick(CCS, 'c_nationkey % 10')} as country_code", "cast(c_custkey as string) as vat_number", "c_custkey % 5 > 0 as valid",
        "c_name as company_name",
    )


def routes(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey as route_id", "36 + (s_suppkey * 7 % 28) * 1.0D as from_lat", "-9 + (s_suppkey * 11 % 45) * 1.0D as from_lon",
        "38 + (s_suppkey * 7 % 28) * 1.0D as to_lat", "-6 + (s_suppkey * 11 % 45) * 1.0D as to_lon",
    )


def region_requests(spark, sf) -> DataFrame:
    return table(spark, sf, "nation").selectExpr(
        "n_nationkey as req_id", f"{pick(CCS, 'n_nationkey % 10')} as country_code",
        f"case when n_nationkey % 5 = 4 then '' when n_nationkey % 5 = 3 then 'R1' else concat({pick(CCS, 'n_nationkey % 10')}, '-R', cast(n_nationkey % 3 as string), case when n_nationkey % 2 = 0 then ' north' else '' end) end as region",
    )


def road_alerts(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "event_id as id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as timestamp", f"{pick(CCS, 'user_id % 10')} as country",
        "case event_id % 4 when 0 then 'accident' when 1 then 'roadwork' when 2 then 'traffic_jam' else 'strike' end as type",
        f"{pick(ROADS, 'event_id % 12')} as location", "concat('Road note ', cast(event_id as string)) as description",
        "case when event_id % 6 <> 0 then 36 + (user_id * 37 % 61) * 0.5D end as lat",
        "case when event_id % 6 <> 0 then -9 + (user_id * 53 % 97) * 0.5D end as lon",
    )

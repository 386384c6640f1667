"""DuckDB views that mirror ``bind``; a query gets the views it names."""

from __future__ import annotations

import re

from cordon.catalog import bind as B
from cordon.refdata import fixed as V


def L(words) -> str:
    return "[" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + "]"


def pick(words, index) -> str:
    return f"{L(words)}[CAST({index} AS INTEGER) + 1]"


def n9(prefix, num) -> str:
    return f"'{prefix}#' || lpad(CAST({num} AS VARCHAR), 9, '0')"


def half(x: str, d: int) -> str:
    """Round half up on the decimal value, as Spark does."""
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {d}) AS DOUBLE)"


def case(key: str, table: dict, default: str = "NULL") -> str:
    q = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def values(rows, cols: str) -> str:
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return L(v)
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, float):
            return f"{v!r}::DOUBLE"
        return str(v)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows) + f") t({cols})"


def hav(a, b, c, d) -> str:
    h = (f"(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2))")
    return f"(12742.0::DOUBLE * atan2(sqrt(least(1.0, {h})), sqrt(1 - least(1.0, {h}))))"


def seg(p, q, a, b, c, d) -> str:
    n = f"((({c})-({a}))*(({c})-({a}))+(({d})-({b}))*(({d})-({b})))"
    t = f"CASE WHEN {n}=0 THEN 0.0 ELSE greatest(0.0, least(1.0, ((({p})-({a}))*(({c})-({a}))+(({q})-({b}))*(({d})-({b})))/{n})) END"
    return hav(p, q, f"({a})+({t})*(({c})-({a}))", f"({b})+({t})*(({d})-({b}))")


AS_OF = f"TIMESTAMP '{B.AS_OF}'"
SEV = case("lower({c})", V.SEVERITY_RANK, "1")


def sev(c="severity") -> str:
    return SEV.replace("{c}", c)


WEIGHT = case("event_type", V.EVENT_WEIGHTS, "2.0")


def days(ts, as_of=AS_OF) -> str:
    return f"floor((epoch_us({as_of}) - epoch_us({ts})) / 86400000000.0)"


def decay(ts="date_occurred", as_of=AS_OF) -> str:
    d = days(ts, as_of)
    return f"CASE WHEN {ts} IS NULL THEN 0.5 WHEN {d} <= 30 THEN 1.0 WHEN {d} <= 90 THEN 0.75 WHEN {d} <= 180 THEN 0.5 ELSE 0.25 END"


_T = pick(B.TYPES, "(user_id * 5 + event_id % 3) % 12")
_C = pick(B.CCS, "user_id % 10")
_M = "(CASE WHEN event_id % 3 = 0 THEN value * 1000 END)"

VIEWS = {
    "incident": f"""SELECT event_id AS id, {_T} AS event_type, ts AS date_occurred, ts + to_minutes(event_id % 120) AS date_collected,
      {_C} AS country_code, CASE WHEN event_id % 11 <> 0 THEN {_C} || '-R' || CAST(user_id % 3 AS VARCHAR) END AS region,
      CASE WHEN event_id % 4 = 1 THEN {pick(B.CITIES, 'user_id % 10')} END AS city,
      36 + (user_id * 37 % 61) * 0.5::DOUBLE + (event_id % 7) * 0.02::DOUBLE AS latitude,
      -9 + (user_id * 53 % 97) * 0.5::DOUBLE + (event_id % 5) * 0.02::DOUBLE AS longitude,
      CASE WHEN event_id % 4 <> 0 THEN {pick(B.ROADS, 'event_id % 12')} END AS road,
      user_id % 20 AS source_id, user_id AS company_id, {n9('Customer', 'user_id')} AS company_name, {n9('Supplier', 'user_id % 20')} AS source_name,
      {pick(B.SOURCE_TYPES, 'user_id % 5')} AS source_type, ((event_id % 20) + 1) / 20.0::DOUBLE AS trust_score,
      (user_id % 20) % 3 = 0 AS is_official, event_id % 2 = 0 AS is_verified, {_M} AS financial_impact_eur,
      CASE WHEN event_id % 4 = 0 THEN 'Report on ' || {n9('Customer', '(user_id * 7 + event_id % 3) % 150')} ELSE 'Incident ' || CAST(event_id AS VARCHAR) || ' in ' || {_C} END AS title,
      CASE WHEN event_id % 9 < 5 THEN {pick(B.NOTES, 'least(event_id % 9, 4)')} ELSE 'Routine note ' || CAST(event_id % 13 AS VARCHAR) END AS description,
      CASE WHEN event_id % 50 <> 0 THEN 'https://n.example.org/a/' || CAST(event_id - CASE WHEN event_id % 7 = 1 THEN 1 ELSE 0 END AS VARCHAR) END AS source_url,
      {pick(B.LANGS, 'user_id % 10')} AS language, [{pick(B.TAGS1, 'event_id % 5')}, {pick(B.TAGS2, 'user_id % 3')}] AS tags,
      nullif(CAST(event_id % 5 AS INTEGER), 0) AS intelligence_tier, {pick(B.CATEGORIES, 'event_id % 6')} AS intelligence_category,
      CASE WHEN event_id % 3 = 1 THEN {pick(B.CARGO, 'event_id % 4')} END AS cargo_type, CASE WHEN event_id % 13 = 0 THEN 'fuel_theft' END AS modus_operandi,
      CASE WHEN event_id % 8 = 0 THEN 'km ' || CAST(event_id % 300 AS VARCHAR) END AS location_detail,
      CASE WHEN {_T} IN ('theft_cargo', 'theft_vehicle') AND {_M} > 50000 THEN 'critical'
        WHEN {_T} IN ('theft_cargo', 'theft_vehicle', 'bankruptcy', 'license_revoked') THEN 'high'
        WHEN {_T} IN ('strike', 'theft_fuel', 'damage', 'payment_issue', 'restructuring', 'route_closure') THEN 'medium'
        WHEN {_T} = 'delay' THEN 'low' ELSE 'info' END AS severity
      FROM events""",
    "company": f"""SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) AS company_type, {pick(B.CCS, 'c_nationkey % 10')} AS country_code,
      {pick(B.STATUSES, 'c_custkey % 6')} AS financial_status, round(abs(c_acctbal) % 100, 2) AS risk_score,
      {pick(B.CCS, 'c_nationkey % 10')} || CAST(c_custkey AS VARCHAR) AS tax_id FROM customer""",
    "financial": f"""SELECT o_orderkey AS id, o_custkey AS company_id, o_orderdate AS date_occurred, o_totalprice AS amount_eur,
      {pick(B.FIN_TYPES, 'o_orderkey % 9')} AS event_type, o_orderpriority AS description FROM orders""",
    "source": f"""SELECT s_suppkey AS id, s_name AS name, {pick(B.SOURCE_TYPES, 's_suppkey % 5')} AS source_type, s_suppkey % 3 = 0 AS is_official,
      {pick(B.CCS, 's_nationkey % 10')} AS country_code, ((s_suppkey % 10) + 1) / 10.0::DOUBLE AS trust_score FROM supplier""",
    "alert": f"""SELECT id, CASE WHEN id % 2 = 0 THEN 'theft_spike' ELSE 'company_risk' END AS alert_type,
      CASE WHEN severity = 'critical' THEN 'critical' WHEN id % 4 = 0 THEN 'medium' ELSE 'high' END AS severity, 'Alert ' || CAST(id AS VARCHAR) AS title,
      CASE WHEN id % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [country_code, {pick(B.CCS, 'id % 10')}] END AS country_codes, region, id % 3 > 0 AS is_active,
      date_collected AS triggered_at, CASE WHEN id % 3 = 0 THEN date_collected + to_hours(id % 48) END AS resolved_at, [id, id + 1, id + 2] AS related_event_ids
      FROM incident WHERE severity IN ('critical', 'high')""",
    "hotspot": """SELECT *, 25.0::DOUBLE AS radius_km, 'theft_cargo' AS hotspot_type, CASE WHEN event_count % 2 = 0 THEN 'low' ELSE 'medium' END AS severity, 'stable' AS trend
      FROM (SELECT country_code, region, round(avg(latitude), 4) AS latitude, round(avg(longitude), 4) AS longitude, count(*) AS event_count,
      max(date_collected) AS last_calculated FROM incident WHERE region IS NOT NULL GROUP BY 1, 2)""",
    "agent": """SELECT country_code, agent_type, CASE n % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'error' ELSE 'stopped' END AS status, last_heartbeat,
      n AS events_collected_today, bad AS errors_today, CASE WHEN n % 3 = 1 THEN 'failed after ' || CAST(n AS VARCHAR) END AS last_error
      FROM (SELECT country_code, source_type AS agent_type, count(*) AS n, max(date_occurred) AS last_heartbeat, count(*) FILTER (WHERE severity = 'info') AS bad
      FROM incident GROUP BY 1, 2)""",
    "subscriber": f"""SELECT s_suppkey AS id, s_name AS company_name, {pick(B.TIERS, 's_suppkey % 4')} AS subscription_tier, s_suppkey % 5 > 0 AS is_active,
      CASE WHEN s_suppkey % 6 = 1 THEN CAST([] AS VARCHAR[]) ELSE [{pick(B.CCS, 's_nationkey % 10')}, {pick(B.CCS, '(s_suppkey * 3) % 10')}] END AS subscribed_countries FROM supplier""",
    "report": f"""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'biweekly' WHEN 1 THEN 'monthly' ELSE 'sales' END AS report_type,
      CASE o_orderstatus WHEN 'F' THEN 'generated' ELSE 'draft' END AS status, o_orderdate AS created_at,
      CASE WHEN o_orderkey % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE [{pick(B.CCS, 'o_custkey % 10')}] END AS countries FROM orders""",
    "request": f"""SELECT c_custkey AS req_id, CASE WHEN c_custkey % 10 = 9 THEN 'Unknown ' || c_name ELSE c_name END AS name,
      CASE WHEN c_custkey % 4 = 0 THEN {pick(B.CCS, '(c_nationkey + 1) % 10')} ELSE {pick(B.CCS, 'c_nationkey % 10')} END AS country_code,
      CASE WHEN c_custkey % 3 = 0 THEN {pick(B.CCS, 'c_nationkey % 10')} || CAST(c_custkey AS VARCHAR) END AS vat_number FROM customer""",
    "vat": f"""SELECT {pick(B.CCS, 'c_nationkey % 10')} AS country_code, CAST(c_custkey AS VARCHAR) AS vat_number, c_custkey % 5 > 0 AS valid, c_name AS company_name FROM customer""",
    "route": """SELECT s_suppkey AS route_id, 36 + (s_suppkey * 7 % 28) * 1.0::DOUBLE AS from_lat, -9 + (s_suppkey * 11 % 45) * 1.0::DOUBLE AS from_lon,
      38 + (s_suppkey * 7 % 28) * 1.0::DOUBLE AS to_lat, -6 + (s_suppkey * 11 % 45) * 1.0::DOUBLE AS to_lon FROM supplier""",
    "region_request": f"""SELECT CAST(n_nationkey AS INTEGER) AS req_id, {pick(B.CCS, 'n_nationkey % 10')} AS country_code,
      CASE WHEN n_nationkey % 5 = 4 THEN '' WHEN n_nationkey % 5 = 3 THEN 'R1' ELSE {pick(B.CCS, 'n_nationkey % 10')} || '-R' || CAST(n_nationkey % 3 AS VARCHAR) || CASE WHEN n_nationkey % 2 = 0 THEN ' north' ELSE '' END END AS region FROM nation""",
    "road_alert": f"""SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, {_C} AS country,
      CASE event_id % 4 WHEN 0 THEN 'accident' WHEN 1 THEN 'roadwork' WHEN 2 THEN 'traffic_jam' ELSE 'strike' END AS type, {pick(B.ROADS, 'event_id % 12')} AS location,
      'Road note ' || CAST(event_id AS VARCHAR) AS description, CASE WHEN event_id % 6 <> 0 THEN 36 + (user_id * 37 % 61) * 0.5::DOUBLE END AS lat,
      CASE WHEN event_id % 6 <> 0 THEN -9 + (user_id * 53 % 97) * 0.5::DOUBLE END AS lon FROM events""",
    "corridor_member": values(
        [(i, n, cc, r) for i, (n, (ccs, r)) in enumerate(V.CORRIDORS.items()) for cc in ccs], "rnk, corridor, cc, roads"
    ),
    "corridor_segment": values([(c, *s) for c, ss in V.CORRIDOR_SEGMENTS.items() for s in ss], "corridor, cc, road"),
    "highway": values(list(V.HIGHWAY_COUNTRIES.items()), "code, countries"),
    "park": values([(i, *p) for i, p in enumerate(V.PARKS)], "rnk, park, cc, lat, lon"),
    "border_crossing": values([(i, name, " ".join(ccs), lat, lon) for i, (name, ccs, lat, lon) in enumerate(V.BORDERS)], "rnk, border, ccs, lat, lon"),
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the views a statement uses, in dependency order."""
    extra = extra or {}
    need: list[str] = []

    def add(name):
        if name in need:
            return
        text = extra.get(name) or VIEWS[name]
        for other in list(VIEWS) + list(extra):
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", text):
                add(other)
        need.append(name)

    for name in list(VIEWS) + list(extra):
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            add(name)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({extra.get(n) or VIEWS[n]})" for n in need)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S.%f')"


def arr(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


def iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%SZ')"

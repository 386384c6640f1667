"""Company registries delivered as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.match import any_of
from cordon.functions.text import debt_event
from cordon.operators.sizes import first_by
from cordon.refdata import fixed as V

REGISTRY = (
    "items array<struct<company_name:string,company_number:string,company_status:string,sic_codes:array<string>,date_of_cessation:string,"
    "date_of_creation:string,registered_office_address:struct<address_line_1:string,locality:string,postal_code:string>>>"
)
REGISTER = "results struct<companies:array<struct<company:struct<name:string,current_status:string,jurisdiction_code:string,updated_at:string,opencorporates_url:string>>>>"


def registry_insolvencies(snapshots: DataFrame) -> DataFrame:
    """Incidents from ``(snapshot_id, json)``: companies of the transport codes in
    an insolvency state, once per company number."""
    i = snapshots.select("snapshot_id", F.posexplode(F.from_json("json", REGISTRY)["items"]).alias("pos", "i")).select("snapshot_id", "pos", "i.*")
    i = i.where(
        (F.coalesce("company_name", F.lit("")) != "") & F.col("company_status").isin(V.REGISTRY_STATUSES)
        & F.arrays_overlap("sic_codes", F.array(*map(F.lit, V.TRANSPORT_SIC)))
    )
    i = first_by(i, ["company_number"], [F.asc("snapshot_id"), F.asc("pos")])
    a = F.col("registered_office_address")
    part = lambda c: F.nullif(a[c], F.lit(""))
    where = F.concat_ws(", ", part("address_line_1"), part("locality"), part("postal_code"))
    gone = F.nullif("date_of_cessation", F.lit(""))
    text = F.concat(F.lit("Company "), F.col("company_number"), F.lit(" ("), F.col("company_name"), F.lit(") — status: "), F.col("company_status"), F.lit(". Address: "), where, F.lit("."))
    text = F.concat(text, F.coalesce(F.concat(F.lit(" Cessation date: "), gone, F.lit(".")), F.lit("")))
    return i.select(
        "company_number", F.concat("company_name", F.lit(" — "), "company_status").alias("title"), text.alias("description"),
        F.coalesce(gone, "date_of_creation").alias("date"), F.lit("GB").alias("country_code"), F.lit("en").alias("language"),
        F.lit(True).alias("is_official"), F.lit(1.0).alias("trust_score"), F.lit("financial").alias("source_type"),
    )


def register_inactive(payloads: DataFrame) -> DataFrame:
    """Transport companies in an inactive state from ``(payload_id, json)``, typed
    liquidation or insolvency, once per name."""
    c = payloads.select("payload_id", F.posexplode(F.from_json("json", REGISTER)["results"]["companies"]).alias("pos", "c")).select("payload_id", "pos", "c.company.*")
    status = F.lower(F.coalesce("current_status", F.lit("")))
    c = c.where(any_of(F.concat_ws(" ", "name", "current_status"), V.REGISTRY_TRADE_WORDS) & any_of(status, V.INACTIVE_STATUSES))
    c = first_by(c.withColumn("_k", F.lower(F.trim("name"))).where(F.col("_k") != ""), ["_k"], [F.asc("payload_id"), F.asc("pos")])
    kind = F.when(F.contains(F.lower("current_status"), F.lit("liquidat")), "liquidation").otherwise("insolvency")
    return c.select(
        F.concat(F.lit("[DEBT] "), "name", F.lit(" — "), kind).alias("title"), kind.alias("debt_type"), debt_event(kind).alias("event_type"),
        F.when(F.coalesce("jurisdiction_code", F.lit("")) != "", F.upper(F.substring("jurisdiction_code", 1, 2))).otherwise("EU").alias("country_code"),
        F.concat(F.lit("Debt registry entry: Company status: "), "current_status", F.lit(" (jurisdiction: "), F.coalesce("jurisdiction_code", F.lit("")), F.lit(")")).alias("description"),
        F.col("updated_at").alias("date"), F.lit(2).alias("intelligence_tier"), F.array(F.lit("debt_registry"), kind, F.lit("OpenCorporates")).alias("tags"),
    )

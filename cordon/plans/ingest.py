"""The whole way from raw rows to stored incidents, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions import text as t
from cordon.functions.values import extract_date, fx_eur, money_eur
from cordon.operators import enrich as e
from cordon.operators.filters import url_policy
from cordon.operators.gates import audit_rows, gdpr_gate, legal_gate, review_rows
from cordon.operators.joins import link_company


@dataclass
class Dictionaries:
    """Reference tables the chain needs; each is replaceable."""

    types: DataFrame
    tags: DataFrame
    languages: DataFrame
    gazetteer: DataFrame
    tiers: DataFrame | None = None  # words of tiers; None leaves rows untiered
    cities: DataFrame | None = None  # names with coordinates; None leaves rows without
    companies: DataFrame | None = None  # stored companies that a row's company_name may mean


def staged(raw: DataFrame, refs: Dictionaries, blocked: list[str] | None = None, check_url: bool = True, keep_agent_fields: bool = True, compat: bool = False, text_chars: int | None = None) -> DataFrame:
    """Every raw row with its processed fields and ``reject_reason`` (null when it
    passes). Order matters: money is read before the scrub, the privacy gate looks
    at title and description only, classification sees the scrubbed text, and the
    wording is made neutral last. Rows are also tiered, given coordinates of their city and the id of the
    company they name, by the tables that ``refs`` holds for it; each is a lookup in the same plan. Of the untouched text only ``original_hash`` stays. Whole texts
    are read; ``text_chars`` cuts the finished raw_text, if given."""
    d = raw.withColumn("original_hash", F.sha2(F.concat_ws("\n", "title", "description", "raw_text"), 256))
    if check_url:
        d = url_policy(d, blocked)
        url_bad = (F.coalesce("source_url", F.lit("")) != "") & F.col("url_verdict").isin("blocked", "login", "paywall")
    else:
        d = d.withColumn("url_verdict", F.lit("ok")).withColumn("host", F.lit(None).cast("string"))
        url_bad = F.lit(False)
    d = d.withColumn("_url_bad", url_bad)
    # fields
    for c in ("title", "description", "raw_text"):
        d = d.withColumn(c, F.trim(F.coalesce(c, F.lit(""))))
    full = F.concat_ws(" ", "title", "description", "raw_text")
    stated = F.coalesce(F.nullif("date", F.lit("")), F.col("timestamp"))
    d = d.withColumn("date_parsed", extract_date(stated, "title", "description", "raw_text"))
    d = d.withColumn("country_code", t.norm_country(F.coalesce("country_code", F.lit(""))))
    d = e.extract_place(d, refs.gazetteer, full)
    own = F.col("financial_impact_eur") if keep_agent_fields and "financial_impact_eur" in raw.columns else F.lit(None).cast("double")
    d = d.withColumn("financial_impact_eur", F.coalesce(own, money_eur(full)))
    if "currency" in raw.columns:
        d = d.withColumn("financial_impact_eur", fx_eur("financial_impact_eur", "currency"))
    # personal data
    for c in ("title", "description", "raw_text"):
        d = d.withColumn(c, t.scrub_pii(c))
    d = gdpr_gate(d.withColumn("is_anonymized", F.lit(True)))
    # normal form and classification
    for c in ("title", "description", "raw_text"):
        d = d.withColumn(c, t.normalise_text(c))
    d = e.detect_language(d, F.concat_ws(" ", "title", "description"), refs.languages, "_lang")
    d = d.withColumn("language", F.coalesce(F.nullif("language", F.lit("")), F.col("_lang"))).drop("_lang")
    clean = F.concat_ws(" ", "title", "description", "raw_text")
    had_type = keep_agent_fields and "event_type" in raw.columns
    if had_type:
        d = d.withColumnRenamed("event_type", "_agent_type")
    d = e.classify_type(d, refs.types, clean)
    if had_type:
        d = d.withColumn("event_type", F.coalesce("_agent_type", "event_type")).drop("_agent_type")
    d = e.severity(d, clean)
    own_tags = F.col("tags") if keep_agent_fields and "tags" in raw.columns else F.array().cast("array<string>")
    d = d.withColumn("_own_tags", own_tags)
    d = e.tags(d, refs.tags, clean)
    d = d.withColumn("tags", F.array_union(F.coalesce("_own_tags", F.array().cast("array<string>")), "tags")).drop("_own_tags")
    d = placed_and_linked(d, refs, clean)
    d = legal_gate(d, compat)
    if text_chars is not None:
        d = d.withColumn("raw_text", F.substring("raw_text", 1, text_chars))
    reason = (
        F.when(F.col("_url_bad"), F.concat(F.lit("url_"), F.col("url_verdict")))
        .when(F.col("gdpr_status") == "non_compliant", "gdpr_non_compliant").when(F.col("legal_reject").isNotNull(), F.col("legal_reject"))
    )
    return d.withColumn("reject_reason", reason).drop("_url_bad", "legal_reject")


def placed_and_linked(d: DataFrame, refs: Dictionaries, text) -> DataFrame:
    """Tier, coordinates and company of typed rows; what a row brings along stays."""
    if refs.tiers is not None:
        d = e.tier(d, refs.tiers, text)
    if refs.cities is not None:
        d = e.geocode(d, "city", refs.cities)
        for own, found in (("latitude", "geo_lat"), ("longitude", "geo_lon")):
            d = d.withColumn(own, F.coalesce(*[F.col(c) for c in (own, found) if c in d.columns])).drop(found)
    if refs.companies is not None and "company_name" in d.columns:
        own = ["company_id"] if "company_id" in d.columns else []
        d = link_company(d, refs.companies, F.col("company_name"), F.col("country_code"), "_linked")
        d = d.withColumn("company_id", F.coalesce(*own, "_linked")).drop("_linked")
    return d


def ingest(raw: DataFrame, refs: Dictionaries, **options) -> tuple[DataFrame, DataFrame]:
    """``(ok, rejected)``; the two partition the input."""
    d = staged(raw, refs, **options)
    return d.where(F.col("reject_reason").isNull()), d.where(F.col("reject_reason").isNotNull())


def ingest_tables(raw: DataFrame, refs: Dictionaries, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(ok, rejected, audit, review)``: as ``ingest``, with an audit row for each input and the rows a person must look at."""
    d = staged(raw, refs, **options)
    outcome = d.withColumn("outcome", F.coalesce("reject_reason", F.lit("stored")))
    ok, rejected = d.where(F.col("reject_reason").isNull()), d.where(F.col("reject_reason").isNotNull())
    return ok, rejected, audit_rows(outcome, "ingest", "outcome", original_hash="original_hash"), review_rows(d)


def starter(spark) -> Dictionaries:
    """English dictionaries to begin with."""
    from cordon.refdata import terms as W
    from cordon.refdata.tables import literal

    lang = literal(spark, [("en", 0, "the and of to in is that for with by".split())], "lang string, rank int, words array<string>")
    return Dictionaries(W.terms(spark, ("en", W.TYPE_TERMS)), W.terms(spark, ("en", W.TAG_TERMS)), lang, e.places(spark), cities=e.gazetteer(spark))

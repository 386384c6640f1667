"""Privacy and legal gates, and the rows they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.functions.text import has_pii, mask_companies, neutralise, scrub_pii, scrub_plates

IMAGE_FIELDS = ("image", "screenshot", "photo", "image_url", "image_data")
TEXT_FIELDS = ("title", "text", "description")
SOCIAL_SOURCES = ("forum", "telegram", "reddit")


def gdpr_gate(df: DataFrame) -> DataFrame:
    """Adds ``gdpr_status`` (compliant, non_compliant, needs_review),
    ``gdpr_fields`` and ``gdpr_action``. Social sources are purged and looked at
    again; official ones go to review; others with personal data are rejected."""
    fields = [c for c in TEXT_FIELDS if c in df.columns]
    images = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in IMAGE_FIELDS if c in df.columns]
    any_image = F.lit(False)
    for c in images:
        any_image = any_image | c
    d = df.withColumn("_img", any_image).withColumn(
        "gdpr_fields", F.array_compact(F.array(*[F.when(has_pii(c), F.lit(c)) for c in fields]))
    )
    social = F.coalesce(F.col("source_type").isin(*SOCIAL_SOURCES), F.lit(False))
    purge = ~F.col("_img") & (F.size("gdpr_fields") > 0) & social
    d = d.withColumn("_purge", purge)
    for c in fields:
        d = d.withColumn(c, F.when(F.col("_purge"), scrub_plates(scrub_pii(c), F.col("is_official"))).otherwise(F.col(c)))
    left = F.lit(False)
    for c in fields:
        left = left | has_pii(c)
    d = d.withColumn("_left", F.col("_purge") & left)
    clean = F.size("gdpr_fields") == 0
    official = F.coalesce("is_official", F.lit(False))
    status = (
        F.when(F.col("_img"), "non_compliant").when(clean, "compliant").when(F.col("_left"), "needs_review").when(F.col("_purge"), "compliant")
        .when(official, "needs_review").otherwise("non_compliant")
    )
    action = (
        F.when(F.col("_img"), "rejected").when(clean, "none").when(F.col("_purge"), "anonymized").when(official, "none").otherwise("rejected")
    )
    return (
        d.withColumn("gdpr_status", status).withColumn("gdpr_action", action)
        .withColumn("gdpr_fields", F.when(F.col("_img"), F.array(F.lit("image_data"))).otherwise(F.col("gdpr_fields")))
        .drop("_img", "_purge", "_left")
    )


def legal_gate(df: DataFrame, compat: bool = False) -> DataFrame:
    """Adds ``legal_reject`` (null when it passes). Passing text is reworded, and
    companies are masked unless an official, trusted source names them."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    reject = F.when(blank("source_url"), "no_source_url").when(blank("timestamp"), "no_timestamp")
    d = df.withColumn("legal_reject", reject)
    may_name = F.coalesce("is_official", F.lit(False)) & (F.coalesce("trust_score", F.lit(0.0)) >= 0.7)
    region = F.coalesce(*[F.col(c) for c in ("region", "country_code") if c in df.columns], F.lit("nieznany"))
    d = d.withColumn("company_masked", ~may_name).withColumn("_region", region)
    for c in TEXT_FIELDS:
        if c in df.columns:
            fair = neutralise(c, compat)
            d = d.withColumn(c, F.when(F.col("legal_reject").isNotNull(), F.col(c)).otherwise(fair))
            d = d.withColumn(c, F.when(F.col("legal_reject").isNull() & F.col("company_masked"), mask_companies(c, "_region")).otherwise(F.col(c)))
    return d.drop("_region")


def audit_rows(gated: DataFrame, stage: str, outcome: str, original: str | None = None, original_hash: str | None = None) -> DataFrame:
    """One audit row per input: stage, outcome and a hash of the untouched text, made here or carried along."""
    digest = F.col(original_hash) if original_hash else F.sha2(F.coalesce(original, F.lit("")), 256)
    return gated.select("source_url", F.lit(stage).alias("action"), F.col(outcome).alias("outcome"), digest.alias("original_data_hash"))


def review_rows(gated: DataFrame) -> DataFrame:
    """Rows a person must look at."""
    return gated.where(F.col("gdpr_status") == "needs_review").select(
        "source_url", F.lit("pii_detected").alias("reason"), F.array_join("gdpr_fields", ",").alias("fields"), F.lit("pending").alias("status")
    )

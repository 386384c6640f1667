"""Corpus pipeline: five stages over the documents table, each calling one of the operators in cordon.llm."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.llm import jaccard, language, mixing, secrets, sentence_pieces
from cordon.session import shared_folder

SURE = 0.2  # language scores below this are rejected


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with no sure language; same columns."""
    held = language.part_of(F.col("doc_id"), 5) == 0
    model = language.fit(docs.select("doc_id", "text", "lang").where(~held))
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"_own_{c}") for c in names])
    told = language.predict(inner, model).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE))
    return told.select(*[F.col(f"`{c if c == 'text' else '_own_' + c}`").alias(c) for c in names])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates; same columns."""
    return jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets; all documents stay, same columns."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target says; same columns."""
    return mixing.repeated(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the piece ids and their number of each row that the mix took."""
    encoded = sentence_pieces.encode(docs.select("doc_id", "source", "text"), sentence_pieces.model_bytes(), keep_text=False)
    return encoded.withColumn("n_pieces", F.coalesce(F.size("ids"), F.lit(0)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_language),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Language scores and Viterbi pieces have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

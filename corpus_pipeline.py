"""A corpus in five stages: language ID, near-dedup, suffix-array dedup, decontamination, packing.

Every stage but the last takes and returns documents with all their columns. Text changes in the third
stage only, where n_chars follows it. doc_id identifies a document; rows without one are nobody's copy and
always stay in the second stage, and repeated rows of one document with equal text count as one there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import decontaminate, language, packing, simhash, suffix
from heliograph.llm.common import spool, table
from heliograph.llm.queries import bpe_path

#: Documents whose language is less certain than this, or that have no letters, are rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language; where lang is null, the prediction takes its place."""
    found = language.identify(docs, carry=docs.columns)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.{c}") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    found = simhash.near_duplicates(docs)
    stays = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of 50 bytes and more that an earlier document has; documents of which nothing is left go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = suffix.dedup(docs, carry=others, as_text=True).withColumnRenamed("kept", "text")
    left = left.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*(new[c].alias(c) if c in new else F.col(f"extra.{c}") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages make up a twentieth or more."""
    scanned = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return scanned.where(~decontaminate.contaminated()).select(*(F.col(f"row.{c}") for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens, with their ids."""
    return packing.pack(docs, bpe_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The network, the fingerprints' components and the packing have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

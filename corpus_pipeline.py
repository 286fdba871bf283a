"""A corpus pipeline over ``documents``: quality rules, language, exact copies,
near copies, packing. Every stage reads what its predecessor kept, written as
Parquet; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import exact, langid, packing, quality, simhash
from marketlens.llm.queries import BYTE_BPE
from marketlens.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; lines above the limits are gone from their texts."""
    return quality.apply_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return langid.drop_unknown(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(BYTE_BPE)).withColumnRenamed("id", "doc_id")


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("packing", pack)]

# Byte statistics, fingerprints and token ids are not SQL; tests hold the
# pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents`` (doc_id, text, lang, source, n_chars and
    any other columns), each written under the checkpoint folder and read again.

    Null or empty texts fail the quality rules; a null source is a host of its
    own; null lang teaches nothing, and without any lang no document has a
    language and none is left. Null and repeated ids are kept apart by file and
    row. An empty table gives an empty result."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

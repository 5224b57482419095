"""The corpus pipeline: documents in, packed training sequences out.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import mixing, near_copies, packing, quality_classifier, secret_scan
from ridgeline.llm.queries import tokenizer_path
from ridgeline.llm.words import bound_batches
from ridgeline.plans.scratch import Scratch, checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays, the one with the smallest doc_id."""
    return near_copies.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: No SQL: the stages train a model and tokenise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    bound_batches(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))

"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents that its predecessor kept and the input folder, and
returns documents in the same columns; the last returns the places of their pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexivec.llm import line_dedup, ngram_join, packing, quality_gam, secret_scan
from lexivec.llm.common import table
from lexivec.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it learns from the labels in ``sf_dir``."""
    return quality_gam.keep_stage(docs, table(spark, sf_dir, "labels"))


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document only."""
    return line_dedup.dedup_stage(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link at Jaccard 0.8 on five-word shingles, the smallest doc_id stays."""
    return ngram_join.keep_one_stage(docs, k=5, num=80, den=100)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets leave the texts; every document stays."""
    return secret_scan.redact_stage(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", cross_site_lines),
    ("ngram_join", near_copies),
    ("secret_scan", secret_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the join and the packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

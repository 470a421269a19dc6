"""The training-data pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``docs``. Rows without a doc_id pass the near-duplicate and passage stages unchanged; null texts fail the quality rules.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import neardup, packing, pii, quality, substring
from paperloom.llm.frames import documents
from paperloom.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or their group's thresholds reject go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the least doc_id stays."""
    return neardup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that an earlier document has in the same run of 13 go, and documents with none left."""
    return substring.keep_rest(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind in brackets."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as token pieces, each with its ids, its sequence and the place in it."""
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

# Hash bits, boosted trees, a linear program and a tokenizer cannot be written in SQL: tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

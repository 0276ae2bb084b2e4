"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  All but the last return the
columns of ``documents`` without the rows that they reject; every stage's result is
written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewlens.llm import exact_dedup, minhash_dedup, packing, quality
from viewlens.llm.common import importable, table, written
from viewlens.llm.queries import WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, quality.best_labels(table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs, threshold=85)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(docs, WORD_BPE))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("minhash_dedup", near_copies),
    ("best_fit_packing", best_fit_packing),
]

# The quality classifier is a fitted model: SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(importable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

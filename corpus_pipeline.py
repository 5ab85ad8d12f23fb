"""A corpus pipeline in stages; each stage's result is written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ablatrix.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules
from ablatrix.llm.catalog import TOKENIZER
from ablatrix.llm.common import key_share, table
from ablatrix.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds good with a probability of at least 0.7."""
    labels = table(spark, sf_dir, "labels").filter(key_share("doc_id", 4) != 2)  # the others stay for tests
    return quality_classifier.keep_good(docs, labels)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id.

    Near-duplicates are those of op2: SimHash of three-word shingles, at most three bits apart. Copies
    that share four fifths of their five-word shingles are mostly further apart and stay (README).
    """
    return near_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in sequences of 2048: one row per piece, with its digest."""
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER), end_id=1)
    return pieces.withColumnRenamed("key", "doc_id").withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", passes_rules),
    ("quality_classifier", good_quality),
    ("near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

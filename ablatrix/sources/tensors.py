"""Tensor tables on disk: attribution, masks, statistics, selected positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.naming import file_safe, strip_module
from ..functions.numeric import format_k
from ..operators.region import stats_text

SELECTED_SCHEMA = "layer_name string, indices array<bigint>, k_value double"


def write_tensors(blocks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Block rows, one folder per checkpoint, sorted by tensor so a filter on it skips row groups."""
    named = blocks.withColumn("tensor", strip_module(F.col("tensor")))
    named.sortWithinPartitions("ckpt", "tensor", "block").write.mode(mode).partitionBy("ckpt").parquet(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """All tensors of all checkpoints; a filter on ``ckpt`` prunes folders."""
    return spark.read.parquet(path).withColumn("ckpt", F.col("ckpt").cast("string"))


def write_masks(selection: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Sparse masks, one folder per checkpoint, side and k label."""
    out = selection.select(
        "ckpt", "side", format_k(F.col("k")).alias("k_label"), "k", "tensor",
        file_safe(F.col("tensor")).alias("mask_name"), "pos",
    )
    out.write.mode(mode).partitionBy("ckpt", "side", "k_label").parquet(path)


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(
        F.col("ckpt").cast("string").alias("ckpt"), "k", "side", "tensor", "pos"
    )


def write_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Layer statistics as CSV text, one folder per checkpoint and k label."""
    stats_text(stats).coalesce(1).write.mode(mode).option("header", True).partitionBy("ckpt", "k_label").csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_selected(indices: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Selected positions as JSON, one folder per checkpoint and k label."""
    indices.withColumn("k_label", format_k(F.col("k_value"))).write.mode(mode).partitionBy("ckpt", "k_label").json(path)


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SELECTED_SCHEMA + ", ckpt string, k_label string, part bigint").json(path)


def write_preview(preview: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counts and first positions as CSV; a re-run replaces it instead of adding rows."""
    # The headers.
    preview.select(
        F.col("tensor").alias("Layer"), F.col("k").alias("K Value"), F.col("index_count").alias("Index Count"),
        F.col("preview").alias("Indices"), "ckpt", format_k(F.col("k")).alias("k_label"),
    ).write.mode(mode).option("header", True).partitionBy("ckpt", "k_label").csv(path)

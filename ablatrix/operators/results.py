"""Evaluation results: which cells are missing, and how scores change under damage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.naming import is_damaged_checkpoint

CELL = ["dataset", "ckpt", "side", "k", "benchmark"]


def expected_cells(checkpoints: DataFrame, ks: Sequence[float], benchmarks: Sequence[str]) -> DataFrame:
    """Every cell an evaluation should fill: per (dataset, ckpt) each k, benchmark and side, and per
    benchmark one undamaged original, which belongs to no checkpoint."""
    runs = checkpoints.select("dataset", "ckpt").distinct().filter(~is_damaged_checkpoint(F.col("ckpt")))
    marks = F.array(*[F.lit(b) for b in benchmarks])
    damaged = (
        runs.withColumn("side", F.explode(F.array(F.lit("top"), F.lit("bottom"))))
        .withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
        .withColumn("benchmark", F.explode(marks))
    )
    originals = (
        checkpoints.select("dataset").distinct()
        .select("dataset", F.lit("original").alias("ckpt"), F.lit("original").alias("side"), F.lit(0.0).alias("k"))
        .withColumn("benchmark", F.explode(marks))
    )
    return damaged.unionByName(originals)


def missing_cells(results: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(results.select(*CELL).distinct(), CELL, "left_anti")


def cell_scores(results: DataFrame) -> DataFrame:
    """Mean score and number of items per cell."""
    return results.groupBy(*CELL).agg(F.avg("correct").alias("score"), F.count("*").alias("n_items"))


def score_changes(results: DataFrame) -> DataFrame:
    """Damaged minus original score per cell."""
    scores = cell_scores(results)
    base = scores.filter(F.col("side") == "original").select(
        "dataset", "benchmark", F.col("score").alias("original_score")
    )
    damaged = scores.filter(F.col("side") != "original")
    return damaged.join(base, ["dataset", "benchmark"]).withColumn(
        "change", F.col("score") - F.col("original_score")
    )


def change_matrix(results: DataFrame, benchmarks: Sequence[str]) -> DataFrame:
    """Score changes with one column per benchmark."""
    return (
        score_changes(results)
        .groupBy("dataset", "ckpt", "side", "k")
        .pivot("benchmark", list(benchmarks))
        .agg(F.first("change"))
    )

"""The table side of training: rows, padding, workers, batches, checkpoint labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as ar
from ..functions.hashing import order_hash
from ..functions.permutation import permuted_column
from .running import hashed_rank

# Fixed value: label positions with this id do not count.
IGNORED_LABEL = -100


def training_rows(samples: DataFrame, length: int | None = None) -> DataFrame:
    """``input_ids`` and equal ``labels``, cut to ``length`` when given."""
    ids = F.col("tokens") if length is None else ar.truncate(F.col("tokens"), length)
    return samples.withColumn("input_ids", ids).withColumn("labels", F.col("input_ids")).drop("tokens")


def pad_rows(rows: DataFrame, length: int, pad: int) -> DataFrame:
    """Fill ids with ``pad`` and labels with the ignored label, and mark valid positions."""
    padded = rows.withColumns(
        {
            "input_ids": ar.pad_right(F.col("input_ids"), length, pad),
            "labels": ar.pad_right(F.col("labels"), length, IGNORED_LABEL),
        }
    )
    return padded.withColumn("attention_mask", ar.valid_positions(F.col("input_ids"), pad))


def assign_workers(samples: DataFrame, workers: int, seed: int = 0, key: str = "sample_id") -> DataFrame:
    """Shuffle samples and deal them to workers in turn; the first ones are dealt again so that
    every worker gets equally many. Adds ``worker`` and ``turn`` (0-based place at the worker).

    ``key`` numbers the samples from 0 on, each once, as packed tables do: a sample's rank is then arithmetic,
    and no row is moved. Other unique keys are ranked by a seeded hash.
    """
    total, first, last = samples.agg(F.count("*"), F.min(key), F.max(key)).first()
    if total and (first, last) == (0, total - 1):
        ranked = samples.withColumn("rank", permuted_column(F.col(key), total, seed))
    else:
        ranked = hashed_rank(samples.withColumn("__h", order_hash(seed, F.col(key))), "__h", key, into="rank").drop("__h")
    fill = -total % workers if total else 0
    # A tiny table may need its rows more than once to fill the last round.
    repeats = F.expr(f"sequence(rank, {total + fill - 1}L, {max(total, 1)}L)")
    dealt = ranked.withColumn("rank", F.explode(repeats)) if fill else ranked
    return dealt.withColumns(
        {
            "worker": F.pmod("rank", F.lit(workers)).cast("int"),
            "turn": F.floor(F.col("rank") / workers).cast("bigint"),
        }
    )


def group_batches(dealt: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """One row per (worker, batch) with at most ``size`` samples, in turn order."""
    keyed = dealt.withColumn("batch_id", F.floor(F.col("turn") / size).cast("bigint"))
    return keyed.groupBy("worker", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", *columns))).alias("samples")
    )


def checkpoint_interval(n: int, full: bool = False) -> int:
    """Samples between two checkpoints for ``n`` training samples."""
    if full:
        return n
    # Intervals by the number of samples.
    for interval in (100_000, 10_000, 1_000, 100):
        if n >= interval:
            return interval
    raise ValueError("fewer than 100 samples: ask for one full checkpoint")


def checkpoint_of(position: Column, n: int, batch: int, interval: int) -> Column:
    """Sample count of the checkpoint that first covers the 0-based ``position``.

    Checkpoint j is saved at step ceil(j * interval / batch); several in one step count as the
    last of them. Null after the last one. Arithmetic per row, no lookup.
    """
    last = n // interval
    step = F.floor(position / batch) + 1
    first = F.floor((step - 1) * batch / interval) + 1
    save_step = F.ceil(first * interval / batch)
    j = F.least(F.floor(save_step * batch / interval), F.lit(last))
    return F.when(first <= last, j * interval).cast("bigint")


def label_checkpoints(samples: DataFrame, batch: int, position: str = "rank", full: bool = False) -> DataFrame:
    """Add ``step`` (1-based) and ``ckpt_samples`` to ranked samples."""
    n = samples.count()
    interval = checkpoint_interval(n, full)
    at = F.col(position)
    return samples.withColumns(
        {
            "step": (F.floor(at / batch) + 1).cast("bigint"),
            "ckpt_samples": checkpoint_of(at, n, batch, interval),
        }
    )

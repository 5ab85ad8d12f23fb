"""Gradient tables: accumulation over batches, means over workers, gradient times weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.naming import strip_module
from . import blocks as bk


def explode_blocks(blocks: DataFrame, column: str = "vals", value: str = "val") -> DataFrame:
    """Block rows to one row per element, ``i`` being the place inside the block."""
    kept = [c for c in blocks.columns if c != column]
    return blocks.select(*kept, F.posexplode(column).alias("i", value))


#: Partial sums that are added in one group: so many neighbouring batches, as a power of two.
FAN_BITS = 4


def accumulate(grads: DataFrame, how: str = "sum", keys: tuple[str, ...] = ("tensor", "block"), batch: str = "batch") -> DataFrame:
    """Combine the gradient blocks of many batches or workers, whole arrays at a time.

    ``sum`` adds batches up, ``mean`` averages workers, ``last`` keeps the latest batch. Batches are whole
    numbers. Sixteen neighbouring ones are added in a group, sixteen of these sums in the next round, and so
    on, always in order: the result has the same bits however rows are partitioned, a block with very many
    batches is many groups, and no element is a row of its own. Rows of one batch are added in order
    of their values; blocks of different lengths raise an error.
    """
    keys = list(keys)
    if how == "last":
        return grads.groupBy(*keys).agg(F.max_by("grad", batch).alias("grad"))
    if how not in ("sum", "mean"):
        raise ValueError("how is sum, mean or last")
    first, last = grads.agg(F.min(batch).cast("bigint"), F.max(batch).cast("bigint")).first()
    part = grads.select(
        *keys, (F.col(batch).cast("bigint") - F.lit(first or 0)).alias("__at"), F.col("grad").cast("array<double>").alias("__sum"),
        F.lit(1).cast("bigint").alias("__n"),
    )
    span = (last or 0) - (first or 0)
    while True:
        part = part.groupBy(*keys, F.shiftright("__at", FAN_BITS).alias("__up")).applyInArrow(bk.added_blocks(len(keys)), part.schema)
        span >>= FAN_BITS
        if not span:
            break
    divisor = F.col("__n") if how == "mean" else F.lit(1)
    return part.select(*keys, F.transform("__sum", lambda x: (x / divisor).cast("float")).alias("grad"))


def grad_times_weight(grads: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("tensor", "block"), rounded: bool = True) -> DataFrame:
    """Attribution blocks ``vals``: gradient times weight in float32, rounded to bfloat16.

    Blocks meet on (tensor, block), so no tensor is ever a single row or task.
    """
    clean = grads.withColumn("tensor", strip_module(F.col("tensor")))
    pairs = clean.join(weights, list(keys))
    schema = pairs.drop("grad", "weight").withColumn("vals", F.lit(None).cast("array<float>")).schema
    return pairs.mapInArrow(bk.product_kernel(rounded, "grad", "weight", "vals"), schema)

"""Seeded order keys that do not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 60


def order_hash(seed: int, *parts: Column) -> Column:
    """A 60-bit uniform integer from the seed and the row's identity."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")

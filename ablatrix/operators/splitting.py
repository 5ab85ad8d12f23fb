"""Train/test splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.hashing import HASH_BITS, order_hash
from ..session import stage


def split_stable(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` by a hash of the key: a row keeps its side when others come or go."""
    cut = round(test_share * 10_000)
    side = F.when(F.pmod(order_hash(seed, F.col(key)), F.lit(10_000)) < cut, "test").otherwise("train")
    return df.withColumn("split", side)


#: Bits of one digit: its counts, 2**15 at most, come to the driver.
DIGIT_BITS = 15


def _largest(values: DataFrame, need: int) -> tuple[int, int]:
    """The ``need``-th largest of the 60-bit integers in column ``v``, and how many rows of that value are needed.

    Digit by digit from the top: each pass counts rows per digit, map-side first, under the prefix so far.
    """
    prefix = 0
    for shift in range(HASH_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = values.filter(F.shiftright("v", shift + DIGIT_BITS) == prefix)
        digit = F.shiftright("v", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        for row in sorted(inside.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), reverse=True):
            if need <= row["n"]:
                prefix = prefix << DIGIT_BITS | row["d"]
                break
            need -= row["n"]
    return prefix, need


def split_exact(df: DataFrame, key: str | None = None, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` with exactly ceil(share * n) test rows, the highest by seeded hash.

    Keys may be of any type, null or repeated: rows of one key follow in order of a hash of their content, and
    without ``key`` rows are known by their content alone. Rows equal in all columns are told apart by where they
    are stored, which matters to no result; it takes a written copy, made only if the cut goes through such rows.
    Only hashes are read to find the cut; the rows themselves are labelled where they lie.
    """
    n_test = math.ceil(test_share * df.count())
    if n_test == 0:
        return df.withColumn("split", F.lit("train"))
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    orders = ([order_hash(seed, F.col(key))] if key else []) + [order_hash(seed, content)]
    test, tied, need = F.lit(False), F.lit(True), n_test
    for order in orders:
        at, need = _largest(df.filter(tied).select(order.alias("v")), need)
        test, tied = test | (tied & (order > at)), tied & (order == at)
        if df.filter(tied).limit(need + 1).count() == need:
            return df.withColumn("split", F.when(test | tied, "test").otherwise("train"))
    rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    place = F.lit((1 << HASH_BITS) - 1) - F.col("__row")
    at, _ = _largest(rows.filter(tied).select(place.alias("v")), need)
    return rows.withColumn("split", F.when(test | (tied & (place >= at)), "test").otherwise("train")).drop("__row")


def ensure_splits(df: DataFrame, key: str | None = None, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Split 80:20 when the table has a single split; otherwise keep its splits."""
    if "split" in df.columns and df.select("split").distinct().limit(2).count() > 1:
        return df
    return split_exact(df, key, test_share, seed)

"""Exact order statistics on tables of any size and any amount of ties.

The order is total: key descending, then position ascending. An element at a given rank is found
digit by digit: each pass counts rows per value of the next digit (partial counts before the
shuffle, few distinct values), finds the digit that holds the rank, and keeps only
rows with that prefix. No pass sorts rows or gathers a group of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import null_safe_join, settle, small_table


# The digits of an element: source column and bits dropped. Keys run from large to small,
# positions from small to large.
DIGITS = {
    "__high": ("key", 16),
    "at_key": ("key", 0),
    "__far_pos": ("pos", 28),
    "__near_pos": ("pos", 14),
    "at_pos": ("pos", 0),
}

# (digit, prefix columns, prefixes found so far and their rows when local) -> prefix, digit, __n
Counter = Callable[[str, list[str], DataFrame | None, list | None], DataFrame]


def count_rows(rows: DataFrame) -> Counter:
    """Counting on a table of elements: groups, ``key`` and ``pos``."""
    rows = rows.withColumns({d: F.shiftright(source, bits) for d, (source, bits) in DIGITS.items()})

    def count(into: str, prefix: list[str], found: DataFrame | None, local: list | None) -> DataFrame:
        inside = rows if found is None else _only(rows, found, local, prefix)
        return inside.groupBy(*prefix, into).agg(F.count("*").alias("__n"))

    return count


def _only(rows: DataFrame, found: DataFrame, local: list | None, prefix: list[str]) -> DataFrame:
    """Rows with one of the prefixes found so far."""
    prefixes = found.select(*prefix).distinct()
    if local is not None:
        values = sorted({tuple(r[c] for c in prefix) for r in local}, key=repr)
        prefixes = small_table(rows.sparkSession, values, prefixes.schema)
    return null_safe_join(rows, prefixes, prefix)


def _refine(counts: DataFrame, wanted: DataFrame, prefix: list[str], into: str) -> DataFrame:
    """Find, for each wanted rank, the digit value it falls in, and its rank inside that value."""
    group = Window.partitionBy(*prefix)
    run = group.orderBy(F.col(into).desc() if DIGITS[into][0] == "key" else F.col(into).asc())
    counts = counts.withColumns(
        {
            "__upto": F.sum("__n").over(run.rowsBetween(Window.unboundedPreceding, 0)),
            "__all": F.sum("__n").over(group),
        }
    )
    found = null_safe_join(counts, wanted.drop("__n"), prefix)
    # Ranks of the far side count from the other end of the same order.
    found = found.withColumns(
        {
            "__upto": F.when(F.col("far"), F.col("__all") - F.col("__upto") + F.col("__n")).otherwise(F.col("__upto")),
            "__left": F.least("__left", "__all"),
        }
    )
    return (
        found.filter((F.col("__left") <= F.col("__upto")) & (F.col("__left") > F.col("__upto") - F.col("__n")))
        .withColumn("__left", F.col("__left") - (F.col("__upto") - F.col("__n")))
        .drop("__upto", "__all")
    )


def locate_bounds(
    count: Counter, wanted: DataFrame, groups: list[str], max_pos: int = 2**62
) -> tuple[DataFrame, list | None]:
    """The bound (``at_key``, ``at_pos``) of the first ``rank`` elements of each group's order.

    Elements have a ``key`` (below 2**32) and a ``pos`` (not negative, unique in the group).
    ``wanted``: groups (at least one), ``rank`` (from 1) and ``far`` (count from the end of the
    order). A rank beyond the group takes all of it. Where every element with the bounding key is
    taken, ``at_pos`` is open-ended; positions are read only for ranks that cut through ties, and
    digits that no position up to ``max_pos`` has are skipped.
    Other columns of ``wanted`` are kept. Returns the table and its rows when local.
    """
    asked = wanted.columns

    def step(into: str, prefix: list[str], found: DataFrame, local: list | None, first: bool = False):
        counts = count(into, prefix, None if first else found, local)
        return settle(_refine(counts, found, prefix, into))

    wanted = wanted.withColumn("__left", F.col("rank"))
    found, local = step("__high", groups, wanted, None, first=True)
    found, local = step("at_key", [*groups, "__high"], found, local)
    found = found.drop("__high")
    open_end = F.when(F.col("far"), F.lit(-1)).otherwise(F.lit(2**62)).cast("bigint")
    whole = F.col("__left") == F.col("__n")
    bounds = found.filter(whole).withColumn("at_pos", open_end).select(*asked, "at_key", "at_pos")
    cut = found.filter(~whole)
    if local is not None:
        cut_rows = [r for r in local if r["__left"] != r["__n"]]
        if not cut_rows:
            done = [r | {"at_pos": -1 if r["far"] else 2**62} for r in local]
            return F.broadcast(bounds), done
    else:
        cut_rows = None
        if cut.isEmpty():
            return bounds, None
    prefix, found, local = [*groups, "at_key"], cut, cut_rows
    for digit in ("__far_pos", "__near_pos"):
        if max_pos >> DIGITS[digit][1]:
            found, local = step(digit, prefix, found, local)
            prefix = [*groups, "at_key", digit]
    by_pos = _refine(count("at_pos", prefix, found, local), found, prefix, "at_pos")
    return settle(bounds.unionByName(by_pos.select(*asked, "at_key", "at_pos")))


def within(key: Column, pos: Column, at_key: Column, at_pos: Column, far: Column) -> Column:
    """Whether a row lies on its side of a bound."""
    tie = key == at_key
    return F.when(far, (key < at_key) | (tie & (pos >= at_pos))).otherwise((key > at_key) | (tie & (pos <= at_pos)))

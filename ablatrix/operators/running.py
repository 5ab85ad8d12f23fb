"""Running sums and dense ids over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import HASH_BITS


def id_levels(key: str | Column) -> list[Column]:
    """Block columns for a 64-bit id: 2**16 ids per block, 2**24 blocks per group.

    Every window partition stays bounded whatever the ids look like: dense, sparse or clustered.
    """
    c = F.col(key) if isinstance(key, str) else key
    return [F.shiftright(c, 16), F.shiftright(c, 40)]


def hash_levels(key: str | Column) -> list[Column]:
    """Block columns for a uniform order hash: 2**20 blocks in 2**10 groups."""
    c = F.col(key) if isinstance(key, str) else key
    return [F.shiftright(c, HASH_BITS - 20), F.shiftright(c, HASH_BITS - 10)]


def _group_keys(df: DataFrame, by: Sequence[str]) -> dict[str, Column]:
    """Non-null stand-ins for the ``by`` columns, so that null groups survive a plain equi-join
    and the join can use the partitioning of the window."""
    keys: dict[str, Column] = {}
    for i, name in enumerate(by):
        kind = df.schema[name].dataType
        blank = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
        keys[f"__by{i}"] = F.coalesce(F.col(name), blank)
        keys[f"__null{i}"] = F.col(name).isNull()
    return keys


def running_sums(
    df: DataFrame,
    order: Sequence[str | Column],
    levels: Sequence[Column],
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add, per name in ``sums``, the exclusive running sum of its expression in ``order``.

    ``levels`` are block columns from fine to coarse, each non-decreasing along ``order``.
    Block totals are aggregated map-side, summed up level by level on their own small tables,
    and joined back on the finest block, which is also the partitioning of the row window: the
    rows themselves are shuffled once.
    """
    groups = _group_keys(df, by)
    lv = [f"__level{i}" for i in range(len(levels))]
    part = {name: f"__part_{name}" for name in sums}
    lowest = F.lit(-(2**62)).cast("bigint")
    rows = df.withColumns(
        {
            **groups,
            **{n: F.coalesce(e.cast("bigint"), lowest) for n, e in zip(lv, levels)},
            **{part[n]: e.cast("bigint") for n, e in sums.items()},
        }
    )
    by = list(groups)

    totals = []
    for i in range(len(lv)):
        source = totals[-1] if totals else rows
        totals.append(
            source.groupBy(*by, *lv[i:]).agg(*[F.sum(p).alias(p) for p in part.values()])
        )

    def before(window) -> dict[str, Column]:
        return {n: F.coalesce(F.sum(p).over(window), F.lit(0).cast("bigint")) for n, p in part.items()}

    offsets: DataFrame | None = None
    for i in reversed(range(len(lv))):
        window = (
            Window.partitionBy(*by, *lv[i + 1 :]).orderBy(lv[i]).rowsBetween(Window.unboundedPreceding, -1)
        )
        level = totals[i].select(*by, *lv[i:], *[c.alias(f"__off_{n}") for n, c in before(window).items()])
        shared = by + lv[i + 1 :]
        if offsets is not None:
            upper = offsets.withColumnsRenamed({f"__off_{n}": f"__up_{n}" for n in part})
            level = level.join(upper, shared)
            level = level.withColumns(
                {f"__off_{n}": F.col(f"__off_{n}") + F.col(f"__up_{n}") for n in part}
            ).drop(*[f"__up_{n}" for n in part])
        offsets = level

    window = Window.partitionBy(*by, *lv).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in_{n}": c for n, c in before(window).items()})
    return rows.join(offsets, by + lv).select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"__in_{n}") + F.col(f"__off_{n}")).alias(n) for n in part],
    )


def hashed_rank(df: DataFrame, hash_column: str, tie: str, into: str = "rank") -> DataFrame:
    """Dense 0-based rank of the rows by (hash, tie)."""
    return running_sums(df, [hash_column, tie], hash_levels(hash_column), {into: F.lit(1)})

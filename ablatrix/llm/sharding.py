"""Sharding by histogram sort: splitters with near equal bytes, found by exact counts, one exchange.

Rows are ordered by a hash of their text, then by the text's checksum, size, key and place of
origin, so that equal texts stand together. Candidate keys are drawn from the intervals in which a splitter must lie; one
pass counts the exact bytes and rows below each of them, over all rows; the intervals shrink until a
candidate lies within the tolerance of its target. A candidate that begins a group of equal texts
is preferred, so a group is cut only where it is too large for the tolerance. The range table then
says where each row goes, and rows move once, each range to a partition that sorts it.

Defined cases: a null text has no bytes (size 1) and stands with the empty ones, its checksum is
that of no bytes; equal rows are told apart by their place of origin, so even a table of copies is
cut evenly; null keys sort first; empty tables give no rows; input columns named like a result
column are replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import fresh, whole

SHARDS = 8
#: Bytes by which a splitter may miss its target, as a part of a range's share.
TOLERANCE = 0.002
#: Bytes a range, which one task sorts, should have.
RANGE_BYTES = 32 * 2**20
#: Candidates drawn per round in all, at least a few for each open splitter.
CANDIDATES = 256
MAX_ROUNDS = 40

KEY = ["a", "b", "c", "d", "e"]
#: Smaller than every key.
LOWEST = (-(2**63),) * len(KEY)


def size_of(text: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def position(columns: list[np.ndarray], probes: list[tuple[int, ...]]) -> np.ndarray:
    """For each row key the number of the sorted probes that are not above it."""
    first = np.array([p[0] for p in probes], np.int64)
    if len(columns) == 1:
        return np.searchsorted(first, columns[0], side="right")
    at = np.searchsorted(first, columns[0], side="left")
    for value in np.unique(columns[0][np.isin(columns[0], first)]):
        tied = columns[0] == value
        begin, end = np.searchsorted(first, value, side="left"), np.searchsorted(first, value, side="right")
        at[tied] = begin + position([c[tied] for c in columns[1:]], [p[1:] for p in probes[begin:end]])
    return at


def count_below(keys: DataFrame, probes: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """Exact bytes and rows below each of the sorted probes."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            size, *columns = (c.to_numpy() for c in batch.columns)
            at = position(columns, probes)
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(sizes, at, size)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(np.arange(len(rows), dtype=np.int32)), "size": pa.array(sizes), "rows": pa.array(rows),
        })

    counted = keys.select("size", *KEY).mapInArrow(count, "i int, size long, rows long")
    summed = counted.groupBy("i").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
    between = {r["i"]: (r["size"], r["rows"]) for r in summed.collect()}
    out, size, rows = [], 0, 0
    for i in range(len(probes)):
        more = between.get(i, (0, 0))
        size, rows = size + more[0], rows + more[1]
        out.append((size, rows))
    return out


Interval = tuple[tuple[int, ...], tuple[int, ...] | None]


def candidates(keys: DataFrame, intervals: list[Interval], number: int, seed: int) -> list[tuple[int, ...]]:
    """From each of the disjoint intervals (the end is outside) as many keys, those of smallest hash."""
    bounds = sorted({x for interval in intervals for x in interval if x is not None})
    begins = {low: i for i, (low, _) in enumerate(intervals)}
    part = np.array([-1] + [begins.get(x, -1) for x in bounds])

    def best(rows: np.ndarray) -> np.ndarray:
        """Columns: interval, hash, key."""
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        begin = np.searchsorted(rows[:, 0], rows[:, 0], side="left")
        return rows[np.arange(len(rows)) - begin < number]

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + len(KEY)), np.int64)
        for batch in batches:
            order, *columns = (c.to_numpy() for c in batch.columns)
            interval = part[position(columns, bounds)]
            rows = np.stack([interval, order, *columns], axis=1)[interval >= 0]
            held = best(np.concatenate([held, rows]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.T], names=["i", "o", *KEY])

    columns = ", ".join(f"{c} long" for c in ["i", "o", *KEY])
    drawn = keys.select(F.xxhash64(F.lit(seed), KEY[-1]).alias("o"), *KEY).mapInArrow(draw, columns)
    smallest = F.slice(F.sort_array(F.collect_list(F.struct("o", *KEY))), 1, number)
    return [tuple(x[k] for k in KEY) for r in drawn.groupBy("i").agg(smallest.alias("best")).collect() for x in r["best"]]


def splitters(keys: DataFrame, targets: list[int], slack: float) -> list[tuple[tuple[int, ...], int, int]]:
    """For each target the key with about that many bytes below it: (key, bytes, rows)."""
    done: dict[int, tuple[tuple[int, ...], int, int]] = {}
    low = {t: (LOWEST, 0, 0) for t in targets}
    high: dict[int, tuple[tuple[int, ...] | None, int, int]] = {t: (None, 2**63, 0) for t in targets}
    for round_number in range(MAX_ROUNDS):
        left = [t for t in targets if t not in done]
        if not left:
            return [done[t] for t in targets]
        intervals = sorted({(low[t][0], high[t][0]) for t in left}, key=lambda x: x[0])
        drawn = candidates(keys, intervals, max(4, CANDIDATES // len(intervals)), round_number)
        # Each drawn key, and the beginning of its group of equal texts.
        probes = sorted({p for d in drawn for p in (d, d[:3] + LOWEST[3:])})
        counted = [(p, *c) for p, c in zip(probes, count_below(keys, probes))] if probes else []
        drawn.sort()
        # Bytes grow along the probes: what lies about a target is found by search.
        sizes = np.array([p[1] for p in counted], np.int64)
        at = np.array(left, np.int64)
        lows, highs = np.searchsorted(sizes, at, side="right") - 1, np.searchsorted(sizes, at, side="left")
        nears = np.searchsorted(sizes, at - slack, side="left"), np.searchsorted(sizes, at + slack, side="right")
        for t, i, j, begin, end in zip(left, lows.tolist(), highs.tolist(), *[x.tolist() for x in nears]):
            bottom, top = low[t][0], high[t][0]
            inside = bisect.bisect_right(drawn, bottom)
            settled = inside == len(drawn) or (top is not None and drawn[inside] >= top)
            if i >= 0 and counted[i][0] > bottom:
                low[t] = counted[i]
            if j < len(counted) and (top is None or counted[j][0] < top):
                high[t] = counted[j]
            near = counted[begin:end]
            if near:
                done[t] = min([p for p in near if p[0][3:] == LOWEST[3:]] or near, key=lambda p: abs(p[1] - t))
            elif settled:  # no key lies between: one row is larger than the tolerance
                done[t] = min((p for p in (low[t], high[t]) if p[0] is not None), key=lambda p: abs(p[1] - t))
    raise RuntimeError(f"splitters not settled after {MAX_ROUNDS} rounds")


def shard(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """``docs``, moved: with ``size``, ``shard`` (from 0) and ``slot``, a row's place in its shard.

    Each shard is cut into ranges of about ``range_bytes``, one task's work; shards and ranges have
    near equal bytes.
    """
    row, at, base = fresh(docs, "row", "range", "base")
    narrow = [f"__{k}" for k in KEY]
    # Places of origin must not change between the counts and the exchange.
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    t = whole(text)
    keyed = docs.withColumns(dict(zip(narrow, [
        F.xxhash64(t), F.crc32(t.cast("binary")), F.octet_length(t).cast("long"),
        F.coalesce(F.col(key).cast("long"), F.lit(LOWEST[0])), F.col(row),
    ])))
    keys = stage(keyed.select(size_of(text).alias("size"), *[F.col(n).alias(k) for n, k in zip(narrow, KEY)]), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_shard = max(1, ceil(total / shards / range_bytes))
    ranges = shards * per_shard
    targets = sorted({total * i // ranges for i in range(1, ranges)} - {0})
    found = splitters(keys, targets, tolerance * total / ranges)
    at_target = {0: (LOWEST, 0, 0)} | dict(zip(targets, found))
    bounds = [at_target[total * i // ranges] for i in range(ranges)]
    below_rows = [b[2] for b in bounds]
    first_slots = np.array([n - below_rows[i // per_shard * per_shard] for i, n in enumerate(below_rows)], np.int64)
    columns = [keyed.columns.index(n) for n in narrow]
    schema = keyed.withColumns({at: F.lit(0).cast("int"), base: F.lit(0).cast("long")}).schema

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in columns]
            where = position(own, [b[0] for b in bounds]) - 1
            first = first_slots[where]
            where = where.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(where), pa.array(first)], names=[*batch.schema.names, at, base]
            )

    placed = keyed.mapInArrow(place, schema).repartitionById(ranges, at)
    order = Window.partitionBy(at).orderBy(*narrow)
    return placed.withColumns({
        "size": size_of(text),
        "shard": F.expr(f"int(`{at}` div {per_shard})"),
        "slot": (F.col(base) + F.row_number().over(order) - 1).cast("long"),
    }).drop(row, at, base, *narrow)

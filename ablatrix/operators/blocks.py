"""Kernels on value blocks: one block is one array, handled whole in NumPy on Arrow batches.

Spark spreads, filters and joins the block rows; inside a task a block is a few array operations
instead of one row per element. Counting kernels add up over a task before anything is shuffled.
The bit pattern of a float32 magnitude serves as its key: it is an integer below 2**31 with the
same order, as in ``functions.numeric.magnitude_key``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions import permutation
from ..functions.permutation import permuted
from .ranks import DIGITS

# Tasks get these functions by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(permutation)

INFINITY_BITS = 0x7F800000
MAX_OPEN_GROUPS = 64

Group = tuple


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])


def _groups(ckpt: str, start: int, n: int, sizes: list[int | None]) -> Iterator[tuple[Group, slice]]:
    """The runs of a block that belong to one group each: the checkpoint, or a chunk of it."""
    for size in sizes:
        if size is None:
            yield (ckpt,), slice(0, n)
            continue
        for chunk in range(start // size, (start + n - 1) // size + 1):
            yield (ckpt, size, chunk), slice(max(chunk * size - start, 0), min((chunk + 1) * size - start, n))


def _runs(batch: pa.RecordBatch, plan: dict[str, list[int | None]]) -> Iterator[tuple]:
    """(group, tensor, first pos, first gpos, values, keys) of every run; NaN has a key past infinity."""
    names = batch.schema.names
    rows = [batch.column(names.index(c)).to_pylist() for c in ("ckpt", "tensor", "pos", "gpos")]
    for ckpt, tensor, pos, gpos, vals in zip(*rows, _lists(batch.column(names.index("vals")))):
        vals = np.ascontiguousarray(vals, np.float32)
        keys = vals.view(np.uint32) & np.uint32(0x7FFFFFFF)
        for group, run in _groups(ckpt, gpos, len(vals), plan.get(ckpt, [])):
            yield group, tensor, pos + run.start, gpos + run.start, vals[run], keys[run]


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema
    )


def _high_counts(plan: dict) -> Callable:
    """Counts per upper 16 bits of the key, summed over the task."""

    def kernel(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        totals: dict[Group, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*g, int(d), int(n[d])) for g, n in totals.items() for d in np.flatnonzero(n)]
            totals.clear()
            return _columns(rows, schema)

        for batch in batches:
            for group, _, _, _, _, keys in _runs(batch, plan):
                counts = np.bincount(keys[keys <= INFINITY_BITS] >> 16, minlength=1 << 15)
                if group in totals:
                    totals[group] += counts
                else:
                    totals[group] = counts
            if len(totals) > MAX_OPEN_GROUPS:
                yield flush()
        yield flush()

    return kernel


def _prefix_counts(plan: dict, targets: dict[Group, list[tuple]], shift: int | None, under: int | None) -> Callable:
    """Counts per next digit of the elements that have one of their group's ``targets`` as prefix.

    A target is (upper key bits) with the whole key as the next digit (``shift`` is None), or (key) or
    (key, position >> ``under``) with position >> ``shift`` as the next digit.
    """

    def kernel(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, values, counts = [], [], []
            for group, _, _, gpos, _, keys in _runs(batch, plan):
                for prefix in targets.get(group, []):
                    if shift is None:
                        digits = keys[(keys >> 16 == prefix[0]) & (keys <= INFINITY_BITS)]
                    else:
                        digits = np.flatnonzero(keys == prefix[0]) + gpos
                        if under is not None:
                            digits = digits[digits >> under == prefix[1]]
                        digits = digits >> shift
                    if len(digits):
                        found, n = np.unique(digits, return_counts=True)
                        heads.append(((*group, *prefix), len(found)))
                        values.append(found)
                        counts.append(n)
            columns = [
                pa.array([x for head, n in heads for x in [head[i]] * n], f.type) for i, f in enumerate(list(schema)[:-2])
            ]
            for parts in (values, counts):
                columns.append(pa.array(np.concatenate(parts).astype(np.int64) if parts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return kernel


def _picks(plan: dict, cells: dict[Group, list[tuple]]) -> Callable:
    """Elements within a bound; a cell is (k, side, far, at_key, at_pos)."""

    def kernel(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, tensor, pos, gpos, vals, keys in _runs(batch, plan):
                for k, side, far, at_key, at_pos in cells.get(group, []):
                    beyond = keys < at_key if far else (keys > at_key) & (keys <= INFINITY_BITS)
                    ties = np.flatnonzero(keys == at_key)
                    ties = ties[(ties + gpos >= at_pos) if far else (ties + gpos <= at_pos)]
                    hit = np.union1d(np.flatnonzero(beyond), ties).astype(np.int64)
                    if not len(hit):
                        continue
                    n = len(hit)
                    chunk = group[2] if len(group) == 3 else 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([group[0]] * n, pa.string()), pa.array(np.full(n, k)), pa.array([side] * n, pa.string()),
                            pa.array([tensor] * n, pa.string()), pa.array(hit + pos), pa.array(hit + gpos),
                            pa.array(vals[hit]), pa.array(np.full(n, chunk, np.int64)),
                        ],
                        schema=schema,
                    )

    return kernel


def _run(blocks: DataFrame, kernel: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    arrow = pa.schema([(name, kind) for name, _, kind in fields])
    return blocks.mapInArrow(
        lambda batches: kernel(batches, arrow), ", ".join(f"`{name}` {kind}" for name, kind, _ in fields)
    )


_LONG = ("bigint", pa.int64())
_KINDS = {"ckpt": ("string", pa.string())}


def digit_counts(
    blocks: DataFrame, plan: dict[str, list[int | None]], prefix: list[str], into: str, groups: list[str], found: list[dict] | None
) -> DataFrame:
    """How many elements have each value of digit ``into``, under the prefixes ``found`` so far."""
    fields = [(c, *_KINDS.get(c, _LONG)) for c in [*prefix, into, "__n"]]
    if found is None:
        kernel = _high_counts(plan)
    else:
        targets: dict[Group, list[tuple]] = {}
        for row in found:
            tail = tuple(row[c] for c in prefix[len(groups) :])
            known = targets.setdefault(tuple(row[g] for g in groups), [])
            if tail not in known:
                known.append(tail)
        last = DIGITS[prefix[-1]]
        shift = DIGITS[into][1] if DIGITS[into][0] == "pos" else None
        kernel = _prefix_counts(plan, targets, shift, last[1] if last[0] == "pos" else None)
    return _run(blocks, kernel, fields).groupBy(*prefix, into).agg(F.sum("__n").alias("__n"))


def picked(blocks: DataFrame, plan: dict[str, list[int | None]], groups: list[str], bounds: list[dict]) -> DataFrame:
    """Rows (ckpt, k, side, tensor, pos, gpos, val, chunk) of all elements within their bounds."""
    cells: dict[Group, list[tuple]] = {}
    for b in bounds:
        cells.setdefault(tuple(b[g] for g in groups), []).append(
            (b["k"], b["side"], b["far"], b["at_key"], b["at_pos"])
        )
    text, double = ("string", pa.string()), ("double", pa.float64())
    fields = [
        ("ckpt", *text), ("k", *double), ("side", *text), ("tensor", *text), ("pos", *_LONG), ("gpos", *_LONG),
        ("val", "float", pa.float32()), ("chunk", *_LONG),
    ]
    return _run(blocks, _picks(plan, cells), fields)


def random_picks(placed: DataFrame, seed: int) -> DataFrame:
    """Elements whose rank in the seeded permutation of 0 to ``mlp_total`` - 1 is below a k's budget."""
    text, double = ("string", pa.string()), ("double", pa.float64())
    fields = [
        ("ckpt", *text), ("k", *double), ("side", *text), ("tensor", *text), ("pos", *_LONG), ("gpos", *_LONG),
        ("val", "float", pa.float32()), ("chunk", *_LONG),
    ]

    def kernel(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("ckpt", "tensor", "pos", "gpos", "mlp_total", "wanted")]
            for ckpt, tensor, pos, gpos, total, wanted, vals in zip(*rows, _lists(batch.column("vals"))):
                ranks = permuted(np.arange(gpos, gpos + len(vals)), total, seed)
                for w in wanted:
                    hit = np.flatnonzero(ranks < w["budget"])
                    n = len(hit)
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([ckpt] * n, pa.string()), pa.array(np.full(n, w["k"])), pa.array(["random"] * n, pa.string()),
                                pa.array([tensor] * n, pa.string()), pa.array(hit + pos), pa.array(hit + gpos),
                                pa.array(vals[hit], pa.float32()), pa.array(np.zeros(n, np.int64)),
                            ],
                            schema=schema,
                        )

    return _run(placed, kernel, fields)


def added_blocks(n_keys: int) -> Callable:
    """Adds a group's arrays in order; columns are the keys, the place in order, the sum and the number added."""

    def add(key: tuple, table: pa.Table) -> pa.Table:
        places, counts = table.column(n_keys).to_pylist(), table.column(n_keys + 2).to_pylist()
        arrays = _lists(table.column(n_keys + 1).combine_chunks())
        if len({len(a) for a in arrays}) > 1:
            raise ValueError("gradient blocks of one place differ in size")
        order = sorted(range(len(arrays)), key=lambda i: (places[i], arrays[i].tobytes()))
        total = np.zeros(len(arrays[0]))
        for i in order:
            total = total + arrays[i]
        head = [table.column(i).slice(0, 1) for i in range(n_keys)]
        lists = pa.array([total], table.schema.field(n_keys + 1).type)
        return pa.Table.from_arrays([*head, pa.array([key[-1].as_py()], pa.int64()), lists, pa.array([sum(counts)], pa.int64())], names=table.schema.names)

    return add


def product_kernel(rounded: bool, grad: str, weight: str, into: str) -> Callable:
    """Element-wise product of two array columns in float32, optionally rounded to bfloat16."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            g, w = batch.column(names.index(grad)), batch.column(names.index(weight))
            if not g.value_lengths().equals(w.value_lengths()):
                raise ValueError("gradient and weight blocks differ in size")
            with np.errstate(over="ignore", invalid="ignore"):
                out = np.multiply(
                    g.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False),
                    w.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False),
                )
            if rounded:
                out = round_bf16(out)
            ends = np.concatenate([[0], np.cumsum(g.value_lengths().to_numpy(zero_copy_only=False))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.float32()))
            kept = [n for n in names if n not in (grad, weight)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in kept], lists], names=[*kept, into])

    return kernel


def round_bf16(values: np.ndarray) -> np.ndarray:
    """Nearest bfloat16, ties to even; NaN stays NaN."""
    bits = values.view(np.uint32)
    even = (bits >> np.uint32(16)) & np.uint32(1)
    rounded = ((bits + np.uint32(0x7FFF) + even) & np.uint32(0xFFFF0000)).view(np.float32)
    return np.where(np.isnan(values), values, rounded)

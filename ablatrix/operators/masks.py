"""Compressed masks: per block the places to zero, as the smallest of an array, runs or a bitmap.

A mask of a third of all places is a bitmap, one of a stretch a single run, one of a few places an
array, so what is shuffled to the weights follows what the mask holds, not the size of a block. Blocks without
a place have no row. Places are row-major, so a mask with fewer first rows than its parameter is padded by
reading no place there, and one with more is cut by leaving out what lies beyond.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

# Tasks get these functions by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTAINER = "kind string, n int, data binary"
UNUSABLE = ("rank", "inner")


def shape_status(shape: Column, mask_shape: Column) -> Column:
    """How a mask's shape relates to its parameter's: ``equal``; ``pad`` or ``cut`` when only the first dimension
    differs; ``rank`` or ``inner`` when the mask can't be used."""
    rows, mask_rows = F.try_element_at(shape, F.lit(1)), F.try_element_at(mask_shape, F.lit(1))
    inner, mask_inner = (F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))) for s in (shape, mask_shape))
    return (
        F.when(shape == mask_shape, "equal")
        .when(F.size(shape) != F.size(mask_shape), "rank")
        .when(inner != mask_inner, "inner")
        .when(mask_rows < rows, "pad")
        .otherwise("cut")
    )


def encode(places: np.ndarray) -> tuple[str, bytes]:
    """Sorted places of a block in the smallest form."""
    if not len(places):
        return "array", b""
    width = "<u2" if places[-1] < 1 << 16 else "<u4"
    begins = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
    step = np.dtype(width).itemsize
    sizes = {"array": step * len(places), "run": 2 * step * len(begins), "bitmap": int(places[-1]) // 8 + 1}
    kind = min(sizes, key=sizes.get)
    if kind == "array":
        return f"array{step}", places.astype(width).tobytes()
    if kind == "run":
        ends = np.concatenate([begins[1:], [len(places)]]) - 1
        return f"run{step}", np.stack([places[begins], places[ends] - places[begins]], axis=1).astype(width).tobytes()
    bits = np.zeros(int(places[-1]) + 1, bool)
    bits[places] = True
    return "bitmap", np.packbits(bits, bitorder="little").tobytes()


def decode(kind: str, data: bytes) -> np.ndarray:
    if kind == "bitmap":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    values = np.frombuffer(data, f"<u{kind[-1]}" if data else "<u2").astype(np.int64)
    if kind.startswith("array"):
        return values
    begins, more = values[::2], values[1::2] + 1
    return np.repeat(begins - (np.cumsum(more) - more), more) + np.arange(more.sum())


def compressed(blocks: DataFrame, hits: str = "hits") -> DataFrame:
    """Replace sorted places by ``kind``, ``n`` and ``data``."""
    kept = [c for c in blocks.columns if c != hits]
    at = blocks.columns.index(hits)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            packed = [encode(p.astype(np.int64)) for p in np.split(flat, ends[:-1])] if batch.num_rows else []
            new = [pa.array([p[0] for p in packed], pa.string()), column.value_lengths(), pa.array([p[1] for p in packed], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, "kind", "n", "data"])

    empty = blocks.select(*kept, F.lit("").alias("kind"), F.lit(0).alias("n"), F.lit(b"").alias("data"))
    return blocks.mapInArrow(pack, empty.schema)


def zeroed(blocks: DataFrame, values: str = "weight", drop: tuple[str, ...] = ("kind", "n", "data")) -> DataFrame:
    """Blocks with zeros in the places of their ``kind`` and ``data``; unchanged where these are null."""
    kept, at = [c for c in blocks.columns if c not in drop], blocks.columns.index(values)

    def zero(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat = np.array(column.flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            for i, (kind, data) in enumerate(zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist())):
                if kind is not None:
                    own = flat[ends[i]:ends[i + 1]]
                    places = decode(kind, data)
                    own[places[places < len(own)]] = 0
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, column.type.value_type))
            columns = [lists if c == values else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(columns, names=kept)

    return blocks.mapInArrow(zero, blocks.select(*kept).schema)

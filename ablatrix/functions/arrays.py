"""Column kernels on token arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, LongType

from .text import let


def cut_fixed(ids: Column, length: int) -> Column:
    """Pieces of ``length`` ids, the last one shorter; a short array is its own single piece."""
    return let(
        ids,
        lambda a: F.when(F.size(a) <= length, F.array(a)).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(a) - 1) / length).cast("int")),
                lambda i: F.slice(a, i * length + 1, F.lit(length)),
            )
        ),
    )


def pack_or_drop(pieces: Column, length: int) -> Column:
    """All pieces joined as one segment when they fit ``length`` ids, otherwise no segment."""
    return let(
        F.flatten(pieces),
        lambda flat: F.when(F.size(flat).between(1, length), F.array(flat)).otherwise(
            F.slice(F.array(flat), 1, 0)
        ),
    )


@F.arrow_udf(ArrayType(LongType()))
def prefix_sums(lengths: pa.Array) -> pa.Array:
    """Exclusive running sums inside each array."""
    offsets = lengths.offsets.to_numpy()
    values = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(values)])
    own = before[offsets[0]:offsets[-1]] - np.repeat(before[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(own, pa.int64()))


def cut_sizes(sizes: np.ndarray, length: int) -> np.ndarray:
    """Sizes of the pieces of at most ``length`` that stretches of these sizes are cut into."""
    if not len(sizes) or sizes.max() <= length:
        return sizes
    parts = np.maximum(1, -(-sizes // length))
    out = np.full(parts.sum(), length, np.int64)
    out[np.cumsum(parts) - 1] = sizes - (parts - 1) * length
    return out


def greedy_ends(sizes: np.ndarray, length: int) -> list[int]:
    """Ends, in ids, of the runs of consecutive pieces that fit ``length``; each is one search in the running sums."""
    sums, ends, at, base = np.cumsum(sizes), [], 0, 0
    while at < len(sizes):
        at = max(at + 1, int(np.searchsorted(sums, base + length, side="right")))
        end = int(sums[at - 1])
        if end > base:
            ends.append(end)
        base = end
    return ends


def pack_greedy(sentences: pa.ListArray, length: int) -> pa.ListArray:
    """Sentences of ids, cut to pieces, as segments of consecutive pieces; the ids stay where they are."""
    outer, inner = sentences.offsets.to_numpy(), sentences.values.offsets.to_numpy()
    bounds, counts = [np.array([inner[outer[0]]])], [0]
    for begin, end in zip(outer[:-1].tolist(), outer[1:].tolist()):
        ends = greedy_ends(cut_sizes(np.diff(inner[begin:end + 1]).astype(np.int64), length), length)
        bounds.append(inner[begin] + np.array(ends, np.int64))
        counts.append(len(ends))
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), sentences.values.values)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), ids)


def truncate(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def pad_right(ids: Column, length: int, fill: int) -> Column:
    """Exactly ``length`` ids: longer arrays are cut, shorter ones filled at the end."""
    return F.concat(
        truncate(ids, length),
        F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(ids), F.lit(0))),
    )


def valid_positions(ids: Column, pad: int) -> Column:
    """True where the id is not ``pad``, and at the first ``pad`` of the row."""
    return let(
        F.struct(ids.alias("ids"), F.array_position(ids, F.lit(pad)).alias("first")),
        lambda s: F.transform(
            s["ids"], lambda x, i: (x != pad) | (i.cast("bigint") == s["first"] - 1)
        ),
    )


def dense_mask(hits: Column, size: Column) -> Column:
    """A boolean array of ``size`` with True at the 0-based offsets in ``hits``; linear in ``size``.
    Offsets beyond it are ignored."""
    inside = F.filter(F.coalesce(hits, F.array().cast("array<int>")), lambda h: h < size)
    return let(
        F.array_sort(inside),
        lambda h: F.flatten(
            F.concat(
                F.zip_with(
                    F.slice(F.concat(F.array(F.lit(-1)), h), 1, F.size(h)),
                    h,
                    lambda before, at: F.concat(
                        F.array_repeat(F.lit(False), at - before - 1), F.array(F.lit(True))
                    ),
                ),
                F.array(
                    F.array_repeat(
                        F.lit(False), size.cast("int") - 1 - F.coalesce(F.try_element_at(h, F.lit(-1)), F.lit(-1))
                    )
                ),
            )
        ),
    )


def zero_where(vals: Column, mask: Column) -> Column:
    return F.zip_with(vals, mask, lambda v, m: F.when(m, F.lit(0.0).cast("float")).otherwise(v))


def id_edges(ids: Column, bos: int, eos: int) -> tuple[Column, Column]:
    """Whether a segment opens with ``bos`` and whether it closes with ``eos``."""
    return (
        F.coalesce(F.try_element_at(ids, F.lit(1)) == bos, F.lit(False)),
        F.coalesce(F.try_element_at(ids, F.lit(-1)) == eos, F.lit(False)),
    )

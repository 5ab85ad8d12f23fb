"""Hard-negative mining: exact inner products behind bounds from summaries of vector segments.

A vector is stored with the mean and the standard deviation of each of its segments. Over a segment of n
components the inner product of two vectors is n times the product of their means, more or less by at
most n times the product of their deviations; summed over segments this bounds the score from both sides.
Whole vectors are one segment at first, then four, then sixteen, and only pairs whose bounds still reach a
wanted score come to the next level and at last to exact scoring.

Anchors are taken in blocks of bounded size. A block is broadcast and held against all rows; each task keeps
the best rows per anchor and raises its thresholds as it goes. A sixteenth of the rows goes first: what
it finds are the thresholds that all other tasks begin with, so that they send little. The positives of
a block come back, bounded like the block, and their scores are the windows of the search for negatives.

Defined cases: rows without id or label, and vectors that are null or have a null or non-finite component,
take no part; components missing at the end of a shorter vector are 0; a repeated row is a row like
any other, and rows with the anchor's id are never its positives; ties go to the smaller id; an anchor
without positives, and a positive with a negative score, give no rows; an empty table gives none. Scaled
components so large that a score could not be exact raise an error. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

#: Segments of a vector, level by level; each level's borders are among the next one's.
LEVELS = (1, 4, 16)
#: Anchors and what is stored with them, as broadcast.
BLOCK_BYTES = 32 * 2**20
#: Of the rows, one in so many goes first to find thresholds.
FIRST = 16
#: Anchors and rows that meet at once in a task.
ANCHORS, ROWS, ROWS_AT_FIRST = 512, 4096, 256
#: Pairs whose vectors are looked up at once.
PAIRS = 1 << 17
#: Sums of products below this are exact as floating-point numbers.
EXACT = 2**52
NONE = -(2**62)
MOST = 2**62


def borders(size: int) -> np.ndarray:
    return np.arange(LEVELS[-1] + 1) * size // LEVELS[-1]


def summaries(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of the finest segments."""
    edges = borders(vectors.shape[1])
    lengths = np.diff(edges)
    mean, deviation = np.zeros((2, len(vectors), len(lengths)))
    for i in np.flatnonzero(lengths):
        part = vectors[:, edges[i]:edges[i + 1]]
        mean[:, i], deviation[:, i] = part.mean(1), part.std(1)
    return mean, deviation


def features(mean: np.ndarray, deviation: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level means and deviations, each times the root of the segment's length.

    The products of two vectors' features, summed, are the middle and the reach of the bounds. Deviations are
    raised by a ten-millionth of the segment's size, more than they can have lost in computing.
    """
    lengths = np.diff(borders(size))
    total, squares = mean * lengths, (deviation**2 + mean**2) * lengths
    out = []
    for n in LEVELS:
        shape = (len(mean), n, LEVELS[-1] // n)
        length = np.maximum(lengths.reshape(n, -1).sum(1), 1)
        t, q = total.reshape(shape).sum(2), squares.reshape(shape).sum(2)
        out.append((t / np.sqrt(length), np.sqrt(np.maximum(q - t * t / length, 0)) + 1e-7 * np.sqrt(q)))
    return out


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == size).all():
        return values.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size) < lengths[:, None]] = values
    return out


class Best:
    """The ``k`` best (score, id) per anchor and window, in order; free places have the score ``NONE``."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high = low.copy(), high
        self.scores = np.full((*low.shape, k), NONE, np.int64)
        self.ids = np.zeros((*low.shape, k), np.int64)

    def add(self, window: int, anchors: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        within = (scores >= self.low[anchors, window]) & (scores <= self.high[anchors, window])
        if not within.any():
            return
        anchors, ids, scores = anchors[within], ids[within], scores[within]
        own, k = np.unique(anchors), self.scores.shape[2]
        a = np.concatenate([anchors, np.repeat(own, k)])
        i = np.concatenate([ids, self.ids[own, window].ravel()])
        s = np.concatenate([scores, self.scores[own, window].ravel()])
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        kept = place < k
        self.scores[a[kept], window, place[kept]], self.ids[a[kept], window, place[kept]] = s[kept], i[kept]
        self.low[own, window] = np.maximum(self.low[own, window], self.scores[own, window, -1])


def products(a: np.ndarray, b: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products of the pairs ``at``: all at once where many are asked for, else pair by pair."""
    if 4 * len(at[0]) > len(a) * len(b):
        return (a @ b.T)[at]
    out = np.empty(len(at[0]))
    for i in range(0, len(out), PAIRS):
        cut = slice(i, i + PAIRS)
        np.einsum("ij,ij->i", a[at[0][cut]], b[at[1][cut]], out=out[cut])
    return out


def meet(block: dict, part: slice, rows: dict, best: Best, same: bool) -> None:
    """Hold some anchors of a block against some rows: bounds level by level, then exact scores."""
    wanted = block["label"][part, None] == rows["label"]
    if same:
        wanted &= block["id"][part, None] != rows["id"]
    else:
        wanted = ~wanted
    low, high = best.low[part].min(1), best.high[part].max(1)
    at = np.nonzero(wanted & (low <= high)[:, None])
    for (mean_a, dev_a), (mean_b, dev_b) in zip(block["features"], rows["features"]):
        middle, reach = products(mean_a[part], mean_b, at), products(dev_a[part], dev_b, at) + 0.5
        open_ = (middle + reach >= low[at[0]]) & (middle - reach <= high[at[0]])
        at = at[0][open_], at[1][open_]
        if not len(at[0]):
            return
    scores = np.rint(products(block["vectors"][part], rows["vectors"], at)).astype(np.int64)
    for window in range(best.low.shape[1]):
        best.add(window, at[0] + part.start, rows["id"][at[1]], scores)


FOUND = "anchor int, window int, id long, score long"


def _search(shipped, size: int, same: bool, k: int):
    """Tasks that give their best rows per anchor and window."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high = shipped.value
        block = block | {"features": features(block["mean"], block["deviation"], size)}
        best, step = Best(low, high, k), ROWS_AT_FIRST
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                rows = unpacked(batch.slice(begin, step), size)
                for first in range(0, len(block["id"]), ANCHORS):
                    meet(block, slice(first, min(first + ANCHORS, len(block["id"]))), rows, best, same)
                begin, step = begin + step, min(2 * step, ROWS)
        at = np.nonzero(best.scores > NONE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(best.ids[at]), pa.array(best.scores[at])],
            names=["anchor", "window", "id", "score"],
        )

    return search


def unpacked(rows: pa.RecordBatch | pa.Table, size: int) -> dict:
    """Stored rows as arrays, with their features."""
    mean, deviation = matrix(rows.column("mean"), LEVELS[-1]), matrix(rows.column("deviation"), LEVELS[-1])
    return {
        "id": rows.column("id").to_numpy(), "label": rows.column("label").to_numpy(), "vectors": matrix(rows.column("vector"), size),
        "mean": mean, "deviation": deviation, "features": features(mean, deviation, size),
    }


def stored(vectors: DataFrame, id: str, label: str, vector: str, anchors: Column, scale: int) -> tuple[DataFrame, int]:
    """Scaled vectors with their summaries, written once; and the number of components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x) * scale + 1))
    size, most = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(largest), F.lit(0.0))).first()
    if size * most**2 >= EXACT:
        raise ValueError(f"components up to {most} of {size} give scores that can't be exact")
    shape = "id long, label long, is_anchor boolean, first boolean, vector array<int>, mean array<double>, deviation array<double>"

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        offsets = np.arange(len(values) + 1) * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel(), kind))

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                v = np.floor(matrix(batch.column("v"), size) * scale)
                mean, deviation = summaries(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in ("id", "label", "is_anchor", "first")], lists(v.astype(np.int32), pa.int32()),
                        lists(mean, pa.float64()), lists(deviation, pa.float64()),
                    ],
                    names=["id", "label", "is_anchor", "first", "vector", "mean", "deviation"],
                )

    first = F.pmod(F.xxhash64("id", "v"), F.lit(FIRST)) == 0
    return stage(rows.withColumn("first", first).mapInArrow(summarise, shape), "vectors"), size


def best_rows(rows: DataFrame, block: dict, size: int, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> DataFrame:
    """``anchor``, ``window``, ``id``, ``score`` of the ``k`` best rows per anchor and window, with their ``rank``."""
    spark = rows.sparkSession
    plain = {c: a for c, a in block.items() if c != "features"}

    def ranked(found: DataFrame) -> DataFrame:
        window = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)

    def searched(part: DataFrame, low: np.ndarray) -> DataFrame:
        shipped = spark.sparkContext.broadcast((plain, low, high))
        return part.drop("is_anchor", "first").mapInArrow(_search(shipped, size, same, k), FOUND)

    early = ranked(searched(rows.filter("first"), low)).toArrow()
    full = early.filter(pa.compute.equal(early["rank"], k))
    low = low.copy()
    at = full["anchor"].to_numpy(), full["window"].to_numpy()
    low[at] = np.maximum(low[at], full["score"].to_numpy())
    late = searched(rows.filter("not first"), low)
    return ranked(late.union(spark.createDataFrame(early.drop_columns("rank"), FOUND)))


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    vectors: DataFrame, anchors: Column, id: str = "id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per anchor and each of its best rows of the same label, the best rows of other labels within ``band``.

    The band is in hundredths of the positive's score. Components become floor(``scale`` * x).
    """
    rows, size = stored(vectors, id, label, vector, anchors, scale)
    spark = rows.sparkSession
    chosen = stage(rows.filter("is_anchor").drop("is_anchor", "first").withColumn("row", F.monotonically_increasing_id()), "anchors")
    count = chosen.count()
    blocks = -(-count * 8 * (size + 4 * LEVELS[-1]) // block_bytes)
    results = [spark.createDataFrame([], RESULT)]
    for b in range(blocks):
        block = unpacked(chosen.filter(F.pmod("row", F.lit(blocks)) == b).toArrow(), size)
        n = len(block["id"])
        if not n:
            continue
        everything = np.full((n, 1), NONE, np.int64), np.full((n, 1), MOST, np.int64)
        near = best_rows(rows, block, size, *everything, True, positives).toArrow()
        # Windows of an anchor without so many positives, and of those below zero, stay closed.
        low, high = np.full((n, positives), MOST, np.int64), np.full((n, positives), NONE, np.int64)
        at, score = (near["anchor"].to_numpy(), near["rank"].to_numpy() - 1), near["score"].to_numpy()
        # Whole numbers between the two hundredths of a positive's score.
        low[at], high[at] = -(-band[0] * score // 100), band[1] * score // 100
        far = best_rows(rows, block, size, low, high, False, negatives)
        named = pa.table({
            "anchor": near["anchor"], "window": pa.array(at[1], pa.int32()), "anchor_id": block["id"][at[0]],
            "positive_id": near["id"], "positive_score": near["score"],
        })
        shape = "anchor int, window int, anchor_id long, positive_id long, positive_score long"
        joined = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(spark.createDataFrame(named, shape), ["anchor", "window"])
        results.append(stage(joined.select(*spark.createDataFrame([], RESULT).columns), "negatives"))
    out = results[0]
    for part in results[1:]:
        out = out.union(part)
    return out

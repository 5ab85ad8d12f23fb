"""Packing token ids into sequences of fixed length by first-fit decreasing.

A document is cut into full pieces and a rest. The pieces are dealt at random into groups of
bounded size, and each group packs its own, longest first, each into the first sequence with room
for it, which a tournament tree over the free rooms finds in logarithmic time. A group opens no
more sequences than its ids fill; a piece for which no sequence has room is cut to fill the largest
gaps. So only the last sequence of a group has padding.

Defined cases: a null text is empty; every document ends with the end id, so an empty one has one
id; equal rows are documents of their own; an empty table gives no pieces. Of the input's columns
only the key is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import whole
from .tokenizing import blocks, encode_all

LENGTH = 2048
#: Documents per group on average.
GROUP_ROWS = 4096
#: Text bytes per group on average.
GROUP_BYTES = 16 * 2**20


class Rooms:
    """Free rooms of sequences in a tournament tree: a node holds the largest room below it."""

    def __init__(self, rooms: list[int]):
        self.leaves = 1 << max(0, (len(rooms) - 1).bit_length())
        self.tree = [0] * self.leaves + rooms + [0] * (self.leaves - len(rooms))
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self, need: int) -> int:
        """The first sequence with at least this room, or -1."""
        tree, i = self.tree, 1
        if tree[1] < need:
            return -1
        while i < self.leaves:
            i *= 2
            if tree[i] < need:
                i += 1
        return i - self.leaves

    def largest(self) -> int:
        return self.tree[1]

    def take(self, at: int, size: int) -> None:
        tree, i = self.tree, at + self.leaves
        tree[i] -= size
        i //= 2
        while i:
            tree[i] = max(tree[2 * i], tree[2 * i + 1])
            i //= 2


def first_fit_decreasing(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, begin in the item, size, sequence, offset there) of items of at most ``length``."""
    total = sum(sizes)
    rooms = Rooms([length] * (total // length) + ([total % length] if total % length else []))
    used: dict[int, int] = {}
    out = []

    def put(item: int, begin: int, size: int, at: int) -> None:
        out.append((item, begin, size, at, used.get(at, 0)))
        used[at] = used.get(at, 0) + size
        rooms.take(at, size)

    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        begin, left = 0, sizes[item]
        while left:
            at = rooms.first(left)
            size = left if at >= 0 else rooms.largest()
            put(item, begin, size, at if at >= 0 else rooms.first(size))
            begin, left = begin + size, left - size
    return out


PIECES = "key long, start long, doc_tokens long, ids binary, group long"
PACKED = "key long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int, key: str, text: str, length: int, groups: int, kind: str
) -> DataFrame:
    """Pieces of at most ``length`` ids and the group each is dealt to."""
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(text).alias("text"))
    # A hash of the row's place deals any set of rows evenly, equal rows too.
    rows = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        out: dict[str, list] = {n: [] for n in ("key", "start", "doc_tokens", "ids", "group")}
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                n: pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in out.items()
            })

        for batch in blocks(batches, text=1):
            encoded = encode_all(batch.column(1), tokenizer)
            for k, raw, deal in zip(batch.column(0).to_pylist(), encoded, batch.column(2).to_pylist()):
                ids = np.frombuffer(raw + end, "<u4")
                if kind == "<u2" and int(ids.max()) >> 16:
                    raise ValueError("an id needs more than 16 bits; state a larger ids_below")
                ids = ids.astype(kind)
                for number, start in enumerate(range(0, len(ids), length)):
                    group = (deal + number * 0x9E3779B97F4A7C15) % 2**64 % groups
                    values = (k, start, len(ids), ids[start:start + length].tobytes(), group)
                    for into, value in zip(out.values(), values):
                        into.append(value)
                size += len(raw)
                if size > 8 * 2**20:
                    yield flush()
                    out, size = {n: [] for n in out}, 0
        if out["key"]:
            yield flush()

    return rows.mapInArrow(cut, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = LENGTH,
    group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES, ids_below: int = 1 << 16,
) -> DataFrame:
    """Pieces ``key, start, length, doc_tokens, ids, sequence_id, offset``; ids are little-endian uint32.

    ``ids_below`` bounds the ids; up to 65,536 they travel in two bytes each.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(whole(text))), F.lit(0))).first()
    groups = max(1, ceil(rows / group_rows), ceil(size / group_bytes))
    kind = "<u2" if ids_below <= 1 << 16 else "<u4"

    def fill(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        pieces = [np.frombuffer(x, kind) for x in group["ids"].to_pylist()]
        keys, starts = group["key"].to_pylist(), group["start"].to_pylist()
        totals, number = group["doc_tokens"].to_pylist(), group["group"][0].as_py()
        placed = first_fit_decreasing([len(x) for x in pieces], length)
        return pa.table({
            "key": pa.array([keys[p[0]] for p in placed], pa.int64()),
            "start": pa.array([starts[p[0]] + p[1] for p in placed], pa.int64()),
            "length": pa.array([p[2] for p in placed], pa.int64()),
            "doc_tokens": pa.array([totals[p[0]] for p in placed], pa.int64()),
            "ids": pa.array([pieces[i][b:b + s].astype("<u4").tobytes() for i, b, s, _, _ in placed], pa.binary()),
            "sequence_id": pa.array([(number << 32) + p[3] for p in placed], pa.int64()),
            "offset": pa.array([p[4] for p in placed], pa.int64()),
        })

    pieces = cut_documents(docs, tokenizer, end_id, key, text, length, groups, kind)
    return pieces.groupBy("group").applyInArrow(fill, PACKED)


def sequences(packed: DataFrame, pad_id: int, length: int = LENGTH) -> DataFrame:
    """One row per sequence: its ids as an array, padded unless their number is a power of two."""
    def join(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), "<u4").astype(np.int32)
        if len(ids) & (len(ids) - 1):
            ids = np.concatenate([ids, np.full(length - len(ids), pad_id, np.int32)])
        return pa.table({"sequence_id": group["sequence_id"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        join, "sequence_id long, ids array<int>"
    )

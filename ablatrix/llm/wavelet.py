"""Token ids as wavelet matrices, one compressed shard per stretch of documents in key order.

A shard holds the ids of whole documents as bit planes, the highest bit first; behind each plane
the ids are parted, stably, into those with a 0 and those with a 1. Counts of ones per block give
rank and select, and with them access by place, counting and occurrence lookup in any range, from
one file and without decoding it.

Defined cases: a null text is empty; every document ends with the end id, so an empty one has one
id; null keys come first, equal keys stand next to each other in no given order; repeated rows are
documents of their own; an empty table writes no shard. Other columns of the input are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from .common import whole
from .tokenizing import blocks, encode_all

MAGIC = b"WVM1"
#: Bits between two stored counts of ones.
BLOCK = 512
#: Ids after which a shard is closed: few enough for a processor's own cache.
SHARD_IDS = 1 << 19
#: Bytes of a plane that are compressed to see whether all should be.
PROBE = 1 << 12
#: Text bytes a writing task should get.
PART_BYTES = 32 * 2**20


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], ones: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.ones, self.zeros = n, planes, ones, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        left = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ones, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            mask = (left & left.dtype.type(1 << level)).astype(bool)
            plane = np.packbits(mask)
            planes.append(plane)
            ones.append(_block_counts(plane))
            high = left.take(np.flatnonzero(mask))
            left = np.concatenate([left.take(np.flatnonzero(~mask)), high])
            zeros.append(len(left) - len(high))
        return cls(len(ids), planes, ones, zeros)

    def to_bytes(self) -> bytes:
        out = [MAGIC, struct.pack("<QI", self.n, len(self.planes))]
        for plane, ones, zeros in zip(self.planes, self.ones, self.zeros):
            for part in (plane.tobytes(), ones.astype("<u4").tobytes()):
                # A plane whose beginning doesn't shrink is kept as it is (level 0).
                shrinks = len(zlib.compress(part[:PROBE], 1)) < 0.97 * min(len(part), PROBE)
                packed = zlib.compress(part, 1 if shrinks else 0)
                out += [struct.pack("<I", len(packed)), packed]
            out.append(struct.pack("<Q", zeros))
        return b"".join(out)

    @classmethod
    def from_bytes(cls, raw: bytes) -> WaveletMatrix:
        if raw[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, bits = struct.unpack_from("<QI", raw, 4)
        at, planes, ones, zeros = 16, [], [], []
        for _ in range(bits):
            for into, kind in ((planes, np.uint8), (ones, "<u4")):
                size, = struct.unpack_from("<I", raw, at)
                into.append(np.frombuffer(zlib.decompress(raw[at + 4:at + 4 + size]), kind))
                at += 4 + size
            zeros.append(struct.unpack_from("<Q", raw, at)[0])
            at += 8
        return cls(n, planes, ones, zeros)

    def _bit(self, level: int, i: int) -> int:
        return self.planes[level][i >> 3] >> (7 - (i & 7)) & 1

    def _rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = i // BLOCK
        count = int(self.ones[level][block])
        plane = self.planes[level][block * BLOCK // 8:(i + 7) // 8]
        if len(plane):
            count += int(np.bitwise_count(plane).sum())
            if i & 7:
                count -= int(plane[-1] & (0xFF >> (i & 7))).bit_count()
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) one or zero of a plane."""
        counts = self.ones[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts), dtype=np.int64) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        begin = block * BLOCK
        row = np.unpackbits(self.planes[level][begin // 8:(begin + BLOCK) // 8])[:self.n - begin]
        return begin + int(np.flatnonzero(row == bit)[k - counts[block]])

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, rank = self._bit(level, i), self._rank(level, i)
            value = value << 1 | int(bit)
            i = zeros + rank if bit else i - rank
        return value

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            b, e = self._rank(level, begin), self._rank(level, end)
            if token >> (len(self.zeros) - 1 - level) & 1:
                begin, end = zeros + b, zeros + e
            else:
                begin, end = begin - b, end - e
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of a token in a range of places."""
        b, e = self._range(token, begin, self.n if end is None else end)
        return e - b

    def find(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of a token, -1 if there are fewer."""
        begin, end = self._range(token, 0, self.n)
        if not 0 <= k < end - begin:
            return -1
        i = begin + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        bits = len(self.planes)
        left = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            mask = np.unpackbits(self.planes[level], count=self.n).view(bool)
            zeros = self.zeros[level]
            out = np.empty_like(left)
            out[np.flatnonzero(~mask)] = left[:zeros]
            out[np.flatnonzero(mask)] = left[zeros:] | left.dtype.type(1 << (bits - 1 - level))
            left = out
        return left


def _block_counts(plane: np.ndarray) -> np.ndarray:
    counts = np.bitwise_count(plane)
    sums = np.add.reduceat(counts, np.arange(0, len(counts), BLOCK // 8), dtype=np.int64) if len(counts) else []
    return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)


SHARD_SCHEMA = "part int, shard int, n_ids long, keys array<long>, lengths array<long>, matrix binary"


def write_shards(
    docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None,
    bits: int = 16, part_bytes: int = PART_BYTES, shard_ids: int = SHARD_IDS,
) -> str:
    """Encode all texts in ascending key order and write their shards; returns the folder."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "wavelets")
    rows = docs.select(F.col(key).cast("long").alias("key"), whole(text).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, ceil(size / part_bytes))
    # The row number parts equal keys where one key has many rows.
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").drop("row")

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        pieces: list[bytes] = []
        total = 0
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(pieces), "<u4")
            if len(ids) and int(ids.max()) >> bits:
                raise ValueError(f"an id needs more than {bits} bits")
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([number], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()), "keys": pa.array([keys], pa.list_(pa.int64())),
                "lengths": pa.array([[len(p) // 4 for p in pieces]], pa.list_(pa.int64())),
                "matrix": pa.array([WaveletMatrix.build(ids, bits).to_bytes()], pa.binary()),
            })

        for batch in blocks(batches, text=1):
            encoded = encode_all(batch.column(1), tokenizer)
            for k, ids in zip(batch.column(0).to_pylist(), encoded):
                keys.append(k)
                pieces.append(ids + end)
                total += len(ids) // 4 + 1
                if total >= shard_ids:
                    yield close()
                    keys, pieces, total, number = [], [], 0, number + 1
        if keys:
            yield close()

    ordered.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "none").parquet(path)
    return path


def shard_offsets(shards: DataFrame) -> DataFrame:
    """``before``: ids in all shards before a shard. Sums within a part, then over the parts."""
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("upper"))
    local = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return local.join(parts, "part").select("part", "shard", (F.col("upper") + F.col("inner")).alias("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents of a folder of shards: ``key, start, ids`` (little-endian unsigned 32-bit integers)."""
    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                keys = batch.column(2)[row].values
                ends = np.cumsum(batch.column(3)[row].values.to_numpy())
                raw = WaveletMatrix.from_bytes(batch.column(4)[row].as_py()).decode().astype("<u4").tobytes()
                begins = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(keys), 256):
                    b, e = begins[i:i + 256], ends[i:i + 256]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part] * len(b), pa.int32()), "shard": pa.array([shard] * len(b), pa.int32()),
                        "key": keys[i:i + 256], "inner": pa.array(b, pa.int64()),
                        "ids": pa.array([raw[4 * x:4 * y] for x, y in zip(b.tolist(), e.tolist())], pa.binary()),
                    })

    rows = shards.select("part", "shard", "keys", "lengths", "matrix").mapInArrow(
        documents, "part int, shard int, key long, inner long, ids binary"
    )
    # The digest is taken before the join, which then moves narrow rows if ids aren't asked for.
    rows = rows.withColumns({"n_ids": F.length("ids") / 4, "ids_crc32": F.crc32("ids")})
    joined = rows.join(shard_offsets(shards), ["part", "shard"])
    return joined.select(
        "key", (F.col("before") + F.col("inner")).alias("start"), F.col("n_ids").cast("long"), "ids_crc32", "ids"
    )

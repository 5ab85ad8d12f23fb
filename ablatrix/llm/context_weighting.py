"""Language-model scoring by context-tree weighting over bytes.

A text is its lower-cased words with one blank between them and one end byte behind. Each byte is
eight binary decisions; a decision's context is the bits before it in its byte and up to ``DEPTH``
bytes before that. Every context of every depth has a Krichevsky-Trofimov estimate from its counts,
and context-tree weighting mixes the estimates of all depths: a node's weight is its own block
probability against the product of its children's. Where a deeper context was never seen, the deepest
one that was decides.

The model is as large as the corpus makes it, so it is never gathered anywhere. Texts are dealt into
blocks of bounded size. A block asks once for each distinct gram of ``DEPTH + 1`` bytes it holds, and
states its training count; the asked-for grams meet in shards by their two nearest context bytes,
where whole subtrees are summed and weighted; the answers, a log probability for each gram, go back
to the blocks. Only the two topmost levels of the tree, of fixed size, pass through the driver. Word
counts for the unigram base go the same way.

Defined cases: a null text is empty; an empty text is its end alone; rows whose key share is 0 are
held out; a null key counts as the empty text there; without training texts every bit costs one bit
and the base is that of zero counts; repeated rows are texts of their own; an empty table gives no
rows. The result has the key and the scores only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .common import key_share, opened, shipped, slices, whole

DEPTH = 5
END = b"\n"
#: Text bytes of a block.
BLOCK_BYTES = 16 * 2**20
#: Shards per block; a shard holds the subtrees of some pairs of nearest bytes.
SHARDS_PER_BLOCK = 1
MIN_SHARDS = 24

HALF = float(np.log(0.5))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def normalised(text: str | None) -> bytes:
    return b" ".join(words_of(text)) + END


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs; sorts in place."""
    values.sort()
    begins = np.flatnonzero(values[1:] != values[:-1]) + 1
    begins = np.concatenate([np.zeros(min(1, len(values)), np.int64), begins])
    return values[begins], np.diff(begins, append=len(values))


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of the texts its gram: nearest context byte first, the byte itself last."""
    pad = END * depth
    joined = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8).astype(np.uint64)
    n = len(joined) - depth
    code = np.zeros(n, np.uint64)
    for back in range(1, depth + 1):
        code = code << np.uint64(8) | joined[depth - back:depth - back + n]
    code = code << np.uint64(8) | joined[depth:]
    lengths = np.array([len(t) for t in texts])
    begins = np.cumsum(lengths + depth) - (lengths + depth)
    real = np.ones(n, bool)
    for b in range(depth):  # the padding is context only
        at = begins + b - depth
        real[at[at >= 0]] = False
    return code[real]


def all_grams(texts: list[bytes], depth: int) -> np.ndarray:
    """The same for many texts, in parts that fit a processor's cache."""
    return np.concatenate([np.zeros(0, np.uint64), *[grams(texts[i:i + 32], depth) for i in range(0, len(texts), 32)]])


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - float(np.log(np.pi))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by 6; below 1e-9 off for x of 0.5 and more."""
    shift = np.zeros(np.shape(x))
    for k in range(6):
        shift += np.log(x + k)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


class Level:
    """Nodes of one depth: key (context bytes, nearest first, then the bits so far), counts, weights."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = log_block(n0, n1)
        self.log_weighted = own if below is None else np.logaddexp(HALF + own, HALF + below)
        self.share = np.ones(len(keys)) if below is None else np.exp(HALF + own - self.log_weighted)

    def parents(self) -> Level:
        up = (self.keys >> np.uint64(16)) << np.uint64(8) | (self.keys & np.uint64(255))
        keys, place = np.unique(up, return_inverse=True)
        n = len(keys)
        return Level(keys, np.bincount(place, self.n0, n), np.bincount(place, self.n1, n), np.bincount(place, self.log_weighted, n))

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def bit_nodes(codes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Deepest node and outcome of the ``bit``-th decision of each gram."""
    byte = codes & np.uint64(255)
    prefix = np.uint64(1 << bit) | byte >> np.uint64(8 - bit)
    return codes >> np.uint64(8) << np.uint64(8) | prefix, byte >> np.uint64(7 - bit) & np.uint64(1)


def deepest_level(codes: np.ndarray, counts: np.ndarray) -> Level:
    """The level of whole contexts from distinct grams and their counts."""
    seen = counts > 0
    codes, counts = codes[seen], counts[seen].astype(float)
    nodes = [bit_nodes(codes, k) for k in range(8)]
    keys, place = np.unique(np.concatenate([x for x, _ in nodes]), return_inverse=True)
    ones = np.concatenate([x for _, x in nodes]).astype(bool)
    times = np.tile(counts, 8)
    return Level(keys, np.bincount(place, times * ~ones, len(keys)), np.bincount(place, times * ones, len(keys)), None)


def subtree(codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Levels from ``depth`` up to ``top``."""
    levels = [deepest_level(codes, counts)]
    for _ in range(depth - top):
        levels.append(levels[-1].parents())
    return levels


def log10_probabilities(codes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each gram's byte; ``levels`` from the deepest to depth 0."""
    total = np.zeros(len(codes))
    for k in range(8):
        keys, one = bit_nodes(codes, k)
        p = np.full(len(codes), 0.5)
        known = np.zeros(len(codes), bool)
        for level in levels:
            at, found = level.look(keys)
            if found.any():
                n1, n0 = level.n1[at], level.n0[at]
                own = (np.where(one == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
                share = np.where(known, level.share[at], 1.0)
                p = np.where(found, share * own + (1 - share) * p, p)
                known |= found
            keys = keys >> np.uint64(16) << np.uint64(8) | (keys & np.uint64(255))
        total += np.log10(p)
    return total


def shard_of(codes: np.ndarray, depth: int, shards: int) -> np.ndarray:
    """By the two nearest context bytes, so that a shard has whole subtrees."""
    near = codes >> np.uint64(8 * (depth - 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


class Places:
    """Places of codes in a sorted array that has them all: by a hash table, and by search where two
    codes share a slot."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - max(1, (4 * len(codes)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.table[self._slots(codes)] = np.arange(len(codes), dtype=np.int32)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(codes)]
        wrong = np.flatnonzero(self.codes[at] != codes)
        at[wrong] = np.searchsorted(self.codes, codes[wrong])
        return at


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


REQUEST = "kind string, block int, shard int, items binary, counts binary"


def requests(rows: DataFrame, depth: int, shards: int) -> DataFrame:
    """Per block and shard the distinct grams and words, and how often training texts have them."""
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, used, other, size = None, [], [], 0
        words: Counter = Counter()
        unseen: set[bytes] = set()
        for batch in slices(batches):
            for b, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if size and (b != block or size > BLOCK_BYTES):
                    yield from answer(block, used, other, words, unseen)
                    used, other, size, words, unseen = [], [], 0, Counter(), set()
                block, own = b, words_of(t)  # a text is split once, for its words and for its grams
                if h:
                    unseen.update(own)
                else:
                    words.update(own)
                (other if h else used).append(b" ".join(own) + END)
                size += len((other if h else used)[-1])
        if size:
            yield from answer(block, used, other, words, unseen)

    def answer(block, used, other, words, unseen) -> Iterator[pa.RecordBatch]:
        codes, counts = counted(all_grams(used, depth)) if used else (np.zeros(0, np.uint64), np.zeros(0, int))
        if other:
            more, _ = counted(all_grams(other, depth))
            if len(codes):
                more = more[codes[np.minimum(np.searchsorted(codes, more), len(codes) - 1)] != more]
            codes, counts = np.concatenate([codes, more]), np.concatenate([counts, np.zeros(len(more), int)])
        shard = shard_of(codes, depth, shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1))
        rows = []
        for s in range(shards):
            at = order[bounds[s]:bounds[s + 1]]
            if len(at):
                rows.append(("gram", block, s, _pack(codes[at]), _pack(counts[at].astype("<i8"))))
        words.update(dict.fromkeys(unseen - words.keys(), 0))
        parts: dict[int, list[bytes]] = {}
        for w in words:
            parts.setdefault(zlib.crc32(w) % shards, []).append(w)
        for s, own in parts.items():
            own.sort()
            rows.append(("word", block, s, zlib.compress(b" ".join(own), 1), _pack(np.array([words[w] for w in own], "<i8"))))
        for i in range(0, len(rows), 16):
            part = [*zip(*rows[i:i + 16])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()),
                 pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())],
                names=["kind", "block", "shard", "items", "counts"],
            )

    return rows.select("block", "held", "text").mapInArrow(ask, REQUEST)


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a shard and their counts over all blocks, block by block."""
    codes = [_unpack(x.as_py(), "<u8") for x in group["items"]]
    distinct, _ = counted(np.concatenate(codes))
    counts = np.zeros(len(distinct), np.int64)
    for c, raw in zip(codes, group["counts"]):
        counts[np.searchsorted(distinct, c)] += _unpack(raw.as_py(), "<i8")
    return distinct, counts


def tree_top(asked: DataFrame, depth: int) -> list[Level]:
    """Levels 1 and 0, from the shards' sums for each nearest byte: at most 256 x 255 rows."""
    def sums(group: pa.Table) -> pa.Table:
        level = subtree(*_merged(group), depth, 2)[-1]
        keys, place = np.unique((level.keys >> np.uint64(16)) << np.uint64(8) | (level.keys & np.uint64(255)), return_inverse=True)
        n = len(keys)
        return pa.table({
            "node": pa.array(keys.astype(np.int64)), "n0": pa.array(np.bincount(place, level.n0, n)),
            "n1": pa.array(np.bincount(place, level.n1, n)), "below": pa.array(np.bincount(place, level.log_weighted, n)),
        })

    rows = asked.filter("kind = 'gram'").groupBy("shard").applyInArrow(sums, "node long, n0 double, n1 double, below double")
    total = rows.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below"))
    got = total.orderBy("node").toArrow()
    first = Level(*[got[c].to_numpy().astype(np.uint64 if c == "node" else float) for c in ("node", "n0", "n1", "below")])
    return [first, first.parents()]


def gram_answers(asked: DataFrame, depth: int) -> DataFrame:
    box = shipped(asked.sparkSession, tree_top(asked, depth))

    def weigh(group: pa.Table) -> pa.Table:
        codes, counts = _merged(group)
        logs = log10_probabilities(codes, subtree(codes, counts, depth, 2) + opened(box)).astype("<f4")
        values = [_pack(logs[np.searchsorted(codes, _unpack(x.as_py(), "<u8"))]) for x in group["items"]]
        return pa.table({"kind": group["kind"], "block": group["block"], "items": group["items"], "values": pa.array(values, pa.binary())})

    return asked.filter("kind = 'gram'").groupBy("shard").applyInArrow(weigh, "kind string, block int, items binary, values binary")


def word_answers(asked: DataFrame) -> DataFrame:
    def add(group: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for items, counts in zip(group["items"], group["counts"]):
            for w, c in zip(zlib.decompress(items.as_py()).split(b" "), _unpack(counts.as_py(), "<i8").tolist()):
                total[w] += c
        known = sum(1 for c in total.values() if c)
        values = [_pack(np.array([total[w] for w in zlib.decompress(x.as_py()).split(b" ")], "<i8")) for x in group["items"]]
        n = len(values)
        return pa.table({
            "kind": group["kind"], "block": group["block"], "items": group["items"], "values": pa.array(values, pa.binary()),
            "tokens": pa.array([sum(total.values())] + [0] * (n - 1), pa.int64()), "distinct": pa.array([known] + [0] * (n - 1), pa.int64()),
        })

    return asked.filter("kind = 'word'").groupBy("shard").applyInArrow(
        add, "kind string, block int, items binary, values binary, tokens long, distinct long"
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(whole(text))), F.lit(0))).first()[0]
    blocks = max(1, ceil(size / block_bytes))
    shards = max(MIN_SHARDS, blocks * SHARDS_PER_BLOCK)
    # Rows stand by their block in the files, so that a block's requests are made in few pieces.
    rows = docs.select(
        F.col(key).alias("key"), whole(text).alias("text"), (key_share(key, 10) == 0).alias("held"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).drop("row")
    rows = stage(rows.repartition(blocks, "block").sortWithinPartitions("block"), "blocks")
    asked = stage(requests(rows, depth, shards), "requests")
    words = stage(word_answers(asked), "word_counts")
    sums = words.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    trained = rows.filter(~F.col("held")).count()
    tokens = (sums["tokens"] or 0) + trained  # with the ends
    distinct = (sums["distinct"] or 0) + (trained > 0)
    answers = words.select("kind", "block", "items", "values").unionByName(gram_answers(asked, depth))
    kind = rows.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, n_bytes long, bits_per_byte double"
    )

    def block_scores(own: pa.Table, answered: pa.Table) -> pa.Table:
        counts: dict[bytes, int] = {}
        codes, logs = [], []
        for which, items, values in zip(*[answered[c].to_pylist() for c in ("kind", "items", "values")]):
            if which == "word":
                counts.update(zip(zlib.decompress(items).split(b" "), _unpack(values, "<i8").tolist()))
            else:
                codes.append(_unpack(items, "<u8"))
                logs.append(_unpack(values, "<f4"))
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        if len(own):
            code, log = np.concatenate(codes), np.concatenate(logs)
            order = np.argsort(code, kind="stable")
            places, log = Places(code[order]), log[order]
        floor = tokens + 0.1 * (distinct + 1)
        for begin in range(0, len(own), 32):
            texts = [normalised(t) for t in own["text"].slice(begin, 32).to_pylist()]
            values = log[places.of(grams(texts, depth))].astype(float)
            lengths = np.array([len(t) for t in texts])
            out["score"] += np.add.reduceat(values, np.cumsum(lengths) - lengths).tolist()
            out["n_bytes"] += lengths.tolist()
            for t in texts:
                c = np.fromiter(map(counts.__getitem__, t.split()), np.float64)
                c = np.append(c, float(trained))
                out["n_tokens"].append(len(c))
                out["n_known"].append(int((c > 0).sum()))
                out["base_score"].append(float(np.log10((c + 0.1) / floor).sum()))
        n = len(own)
        bits = [-s / np.log10(2) / b for s, b in zip(out["score"], out["n_bytes"])]
        return pa.table({
            "key": own["key"], "held_out": own["held"], "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "n_known": pa.array(out["n_known"], pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()),
            "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
            "n_bytes": pa.array(out["n_bytes"], pa.int64()), "bits_per_byte": pa.array(bits, pa.float64()),
        })

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block_scores, schema).withColumnRenamed("key", key)

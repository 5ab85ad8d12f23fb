"""Tokenising, wavelet matrices, packing and sharding: exact round trips."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ablatrix.llm import packing, sharding, tokenizing, wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n", "a\n\n b", "  x  y ", "it's  'tis\tdon't x y", "<|endoftext|> a", "日本語 テスト", "x" * 300 + " y",
    " \n \n word", "\x1c\x1d a", "😀 😀b", "1234 56.7%", "ǅ ² x² ½.", " é. É, ñ", "a\x85b\xa0c", "a.b", "..", " .", "é z",
]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder(plain, monkeypatch):
    monkeypatch.setattr(tokenizing, "TABLE_SIZE", 5)
    encoder = tokenizing.Encoder(PATH)
    for text in ODD * 2:
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == plain(text)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (511, 3), (513, 70_000), (5000, 300)])
def test_wavelet(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    w = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 17).to_bytes())
    assert w.decode().tolist() == ids.tolist()
    assert [w.access(i) for i in range(0, n, 37)] == ids[::37].tolist()
    for token in {0, 1, top // 2, top, 1 << 20}:
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at) and w.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [w.find(token, k) for k in range(min(len(at), 20))] == at[:20].tolist() and w.find(token, len(at)) == -1


def test_shards(docs, empty, spark, plain):
    path = wavelet.write_shards(docs, PATH, end_id=2, part_bytes=20_000, shard_ids=300)
    rows = wavelet.read_documents(spark.read.parquet(path)).orderBy("start").collect()
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_ids"] for r in rows])[:-1].tolist()
    keys = [-1 if r["key"] is None else r["key"] for r in rows]
    assert keys == sorted(keys)
    got = Counter((r["key"], bytes(r["ids"])) for r in rows)
    assert got == Counter((r["doc_id"], np.array(plain(r["text"]) + [2], "<u4").tobytes()) for r in docs.collect())
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    path = wavelet.write_shards(empty, PATH, end_id=2)
    assert wavelet.read_documents(spark.read.schema(wavelet.SHARD_SCHEMA).parquet(path)).count() == 0


def test_first_fit():
    draw = np.random.default_rng(1)
    for n in (0, 1, 5, 300):
        sizes = draw.integers(1, 33, n).tolist()
        out = packing.first_fit_decreasing(sizes, 32)
        assert len({p[3] for p in out}) == -(-sum(sizes) // 32)
        for i, size in enumerate(sizes):
            own = sorted(p[1:3] for p in out if p[0] == i)
            assert [b for b, _ in own] == np.cumsum([0] + [s for _, s in own])[:-1].tolist() and sum(s for _, s in own) == size
        by = defaultdict(list)
        for p in out:
            by[p[3]].append((p[4], p[2]))
        for parts in by.values():
            parts.sort()
            assert [o for o, _ in parts] == np.cumsum([0] + [s for _, s in parts])[:-1].tolist()
            assert sum(s for _, s in parts) <= 32


@pytest.mark.parametrize("options", [{}, {"length": 16, "group_rows": 4, "group_bytes": 1 << 16, "ids_below": 1 << 20}])
def test_pack(docs, empty, plain, options):
    packed = packing.pack(docs, PATH, end_id=1, **options)
    rows = packed.collect()
    length = options.get("length", 2048)
    want = Counter()
    for r in docs.collect():
        ids = plain(r["text"]) + [1]
        want.update((r["doc_id"], len(ids), i, x) for i, x in enumerate(ids))
    got = Counter()
    by = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        got.update((r["key"], r["doc_tokens"], r["start"] + i, x) for i, x in enumerate(ids))
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist() and sum(n for _, n in parts) <= length
    for r in packing.sequences(packed, 0, length).collect():
        assert len(r["ids"]) == length or len(r["ids"]).bit_count() == 1
    assert packing.pack(empty, PATH, end_id=1).count() == 0


def check_shards(moved, docs, shards):
    rows = moved.select("doc_id", "text", "size", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    sizes = Counter()
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(shards))
    return sizes


def test_shard_cases(docs, empty):
    moved = sharding.shard(docs, shards=4)
    assert {c for c in docs.columns} <= set(moved.columns)
    check_shards(moved, docs, 4)
    assert sharding.shard(empty).count() == 0


def test_shard_sizes(spark):
    """A third of all rows are one row; cuts are even all the same."""
    rows = [(1, "same")] * 1000 + [(i % 9, f"text {i} " * (i % 5)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = check_shards(sharding.shard(docs, range_bytes=4096), docs, 8)
    assert max(sizes.values()) - min(sizes.values()) <= 100


def test_many_splitters_on_the_driver(monkeypatch):
    """20,000 targets: a round's work on the driver is searches, not targets times probes."""
    n, rng, clock = 10**9, np.random.default_rng(3), []
    spread = n // 2**20

    def candidates(_, intervals, number, seed):
        clock.append(time.perf_counter())
        out = []
        for low, high in intervals:
            first, last = max(0, low[0]), n if high is None else high[0]
            out += [(int(x), *[int(x) % 7] * 4) for x in rng.integers(first, max(first + 1, last), number)]
        return out

    monkeypatch.setattr(sharding, "candidates", candidates)
    monkeypatch.setattr(sharding, "count_below", lambda _, probes: [(max(0, p[0]), max(0, p[0]) // spread) for p in probes])
    targets = [n * i // 20_001 for i in range(1, 20_001)]
    found = sharding.splitters(None, targets, 0.002 * n / 20_001)
    clock.append(time.perf_counter())
    assert all(abs(f[1] - t) <= 0.002 * n / 20_001 for f, t in zip(found, targets))
    assert max(np.diff(clock)) < 5

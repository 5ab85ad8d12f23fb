"""Near-duplicates against all pairs."""

import re
import string

import numpy as np
import pytest
import xxhash

from ablatrix.llm import near_dedup as nd


def groups(fps, radius):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def near(draw, n, centers):
    """Fingerprints around some centres, up to four bits off."""
    base = draw.integers(0, 2**63, centers, np.int64)
    out = []
    for _ in range(n):
        x = int(base[draw.integers(centers)])
        for b in draw.integers(0, 63, draw.integers(0, 5)):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("n, centers", [(600, 1), (600, 40), (600, 600)])
def test_components(spark, n, centers):
    draw = np.random.default_rng(n + centers)
    fps = near(draw, n, centers)
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "first long, fp long").repartition(4)
    got = {r["fp"]: r["component"] for r in nd.components(rows, shard_members=40).collect()}
    want = groups(fps, 3)
    assert [got[f] for f in fps] == want


def test_cases(docs, empty):
    got = nd.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["fingerprint"], set()).add(r["component_id"])
    assert all(len(x) == 1 for x in by.values())
    blank = [r for r in got if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in blank} == {0, 1, 2, None} and {r["component_id"] for r in blank} == {0}
    assert nd.near_duplicates(empty).count() == 0


def test_deduplicate(docs, empty):
    kept = nd.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    left = {r["component_id"] for r in nd.near_duplicates(docs).collect()}
    assert sorted(ids) == sorted(left)
    assert nd.deduplicate(empty).count() == 0


def test_long_chain(spark):
    chain = [0]
    for i in range(60):
        chain.append(chain[-1] ^ (1 << i))
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(chain)], "first long, fp long")
    assert {r["component"] for r in nd.components(rows, radius=1, shard_members=8).collect()} == {0}


def test_fingerprints_and_components_from_scratch(spark, docs):
    """The query's rows against words, hashes and distances in plain Python."""
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = [(r["doc_id"], fingerprint(r["text"])) for r in docs.filter("doc_id is not null").collect()]
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    smallest = {g: min(k for (k, _), h in zip(rows, group) if h == g) for g in group}
    want = sorted((k, f"{f:016x}", smallest[g]) for (k, f), g in zip(rows, group))
    got = nd.near_duplicates(docs.filter("doc_id is not null")).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect())) == want

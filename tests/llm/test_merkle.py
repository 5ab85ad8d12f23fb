"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.llm import merkle


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """(root, siblings of each node as (left, right) from its level up)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            begin = i // 8 * 8
            paths[k].append(("".join(nodes[begin:i]), "".join(nodes[i + 1:begin + 8])))
            at[k] = i // 8
        nodes = [H("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def fold(node, path):
    for a, b in path:
        node = H(a + node + b)
    return node


def brute_force(rows):
    """Of rows (key, group, text): sorted tuples of what ``manifest`` gives."""
    groups = {}
    for key, group, text in rows:
        changed = text if text is None or zlib.crc32(str("" if key is None else key).encode()) % 3 else "".join(
            c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(group, []).append((key is not None, key or 0, leaf(key, group, text), leaf(key, group, changed)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([r[2] for r in sorted(groups[g])]) for g in names}
    root, trunk = climb([trees[g][0] for g in names])
    out = []
    for g, upper in zip(names, trunk):
        for slot, ((known, key, own, other), path) in enumerate(zip(sorted(groups[g]), trees[g][1])):
            path = path + upper
            back = fold(other, path)
            out.append((g, key if known else None, slot, own, trees[g][0], root, H("".join(a + b for a, b in path)), back, back == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


CASES = {
    "two groups of one": [(7, "en", "A"), (1, None, "b")],
    "odd": [
        *[(None, None, None), (None, None, "x"), (None, "a", "X"), (3, "a", None), (3, None, "")],
        *[(5, "a", "T")] * 20, (5, "a", "U"), (4, "a", "T"), (6, "a", "t"),
        *[(k, f"g{k % 2}", f"Text {k}") for k in (-(2**63), 2**63 - 1, 0, -1, 1, 4095, 4096, -4096, -4097, 2**40, 2**40 + 1)],
        *[(k, f"g{k % 70}é", "T") for k in range(150)],
    ],
    "large": [(k * 3 % 9001, "en" if k % 3 else "de", f"T{k}") for k in range(9001)] + [(9, "en", f"T{k % 700}") for k in range(3000)],
}


@pytest.mark.parametrize("name", list(CASES))
def test_manifest(name, spark):
    rows = CASES[name]
    df = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "doc_id long, lang string, text string").repartition(4)
    share = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    lower = F.when(share == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(df, fields=("doc_id", "lang", "text"), changed={"text": lower})
    got = got.select("name", "key", "slot", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert order(map(tuple, got.collect())) == order(brute_force(rows))


def test_whole_proofs(spark):
    rows = CASES["odd"][:60]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = merkle.manifest(df, fields=("doc_id", "lang", "text"), proofs=True).collect()
    assert len(got) == len(rows) and len({r["root"] for r in got}) == 1
    for r in got:
        path = [(p["left"].encode(), p["right"].encode()) for p in r["path"]]
        assert merkle.folded(r["leaf"].encode(), path).decode() == r["root"]
        assert merkle.folded(b"0" * 64, path).decode() != r["root"]


def test_odd_rows(docs, empty):
    fields = ("doc_id", "source", "lang", "text")
    columns = docs.withColumns({"leaf": F.lit("mine"), "slot": F.lit(1), "root": F.lit("r"), "key": F.lit("k"), "name": F.lit("n")})
    got = merkle.manifest(columns, fields=fields).collect()
    assert sorted(r["leaf"] for r in got) == sorted(leaf(r["doc_id"], r["source"], r["lang"], r["text"]) for r in docs.collect())
    assert all(r["verified"] for r in got)
    assert merkle.manifest(empty, fields=fields).count() == 0


@pytest.mark.parametrize("n", [0, 1, 320, 321, 3000, 4096])
def test_rank(n):
    lows = np.sort(np.random.default_rng(n).permutation(4096)[:n])
    data = merkle.container(lows)
    asked = np.arange(4096)
    assert (merkle.places(data) == lows).all()
    assert (merkle.rank(data, asked) == np.searchsorted(lows, asked)).all()
    assert len(data) <= 641 + 1

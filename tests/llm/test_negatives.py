"""Hard negatives against scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.llm import hard_negatives as hn


def brute_force(rows, is_anchor, positives=5, negatives=3):
    rows = [
        (i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for anchor, label, v in rows:
        if not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i, other) for i, other, w in rows]
        for s, p, _ in sorted(r for r in scored if r[2] == label and r[1] != anchor)[:positives]:
            far = sorted(r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s)[:negatives]
            out += [(anchor, p, k, n, -s, -t) for k, (t, n, _) in enumerate(far, 1)]
    return sorted(out)


def vectors(seed, n, size, kind):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    labels = rng.integers(0, 6, n)
    v = rng.normal(size=(n, size)) * 0.3 + centres[labels] if kind == "clusters" else rng.integers(-2, 3, (n, size)) / 4
    return [(i, int(label), [float(np.float32(x)) for x in row]) for i, (label, row) in enumerate(zip(labels, v))]


SCHEMA = "id long, label int, vector array<float>"


@pytest.mark.parametrize("kind,n,size,block_bytes", [("clusters", 400, 64, hn.BLOCK_BYTES), ("ties", 500, 20, 40_000), ("ties", 120, 3, 3_000)])
def test_all_pairs(spark, kind, n, size, block_bytes):
    rows = vectors(n, n, size, kind)
    odd = [
        (None, 1, rows[0][2]), (7, None, rows[0][2]), (8, 2, None), (9, 2, [None] * size), (10, 1, [math.nan] * size),
        (20, 1, [math.inf] + [0.0] * (size - 1)), (30, 1, []), (40, 1, [1.0]), (-10, 1, [0.5] * size), (50, 3, [0.0] * size),
        *[rows[10]] * 4, *[rows[11]] * 4,
    ]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    got = hn.mine(df, F.col("id") % 10 == 0, block_bytes=block_bytes)
    want = brute_force(rows + odd, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_odd_tables(spark):
    one = [(0, 1, [1.0, 2.0])]
    for rows in ([], one, one + [(1, 2, [1.0, 2.0])], one + [(1, 1, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("score", "rank", "row", "first", "anchor")})
        assert hn.mine(df, F.col("id") == 0).collect() == []
    with pytest.raises(ValueError, match="exact"):
        hn.mine(spark.createDataFrame([(0, 1, [1e30])], SCHEMA), F.lit(True))


@pytest.mark.parametrize("size", [1, 5, 16, 64, 100])
def test_bounds_hold(size):
    rng = np.random.default_rng(size)
    v = np.concatenate([np.floor(rng.normal(size=(60, size)) * 10.0**rng.integers(0, 6, (60, 1))), np.full((3, size), 7.0), np.zeros((1, size))])
    mean, deviation = hn.summaries(v)
    exact, widths = v @ v.T, []
    for means, deviations in hn.features(mean, deviation, size):
        middle, reach = means @ means.T, deviations @ deviations.T
        assert (np.abs(exact - middle) <= reach + 0.5).all()
        widths.append(reach.sum())
    assert widths == sorted(widths, reverse=True)  # each level is narrower


def test_bounds_save_work(monkeypatch):
    """Vectors that are flat over their segments are told apart before exact scoring."""
    rng = np.random.default_rng(1)
    v = np.repeat(rng.integers(-40, 40, (2000, 16)), 4, 1).astype(float)
    mean, deviation = hn.summaries(v)
    rows = {"id": np.arange(2000), "label": np.arange(2000) % 3, "vectors": v, "features": hn.features(mean, deviation, 64)}
    block = {k: a[:50] if k != "features" else [(m[:50], d[:50]) for m, d in a] for k, a in rows.items()}
    low, high = np.full((50, 1), hn.NONE, np.int64), np.full((50, 1), hn.MOST, np.int64)
    best, exact, step = hn.Best(low, high, 5), [], hn.products
    monkeypatch.setattr(hn, "products", lambda a, b, at: exact.append(len(at[0]) * (a.shape[1] == 64)) or step(a, b, at))
    for begin in range(0, 2000, 100):
        cut = {k: x[begin:begin + 100] if k != "features" else [(m[begin:begin + 100], d[begin:begin + 100]) for m, d in x] for k, x in rows.items()}
        hn.meet(block, slice(0, 50), cut, best, True)
    scores = np.where((block["label"][:, None] == rows["label"]) & (block["id"][:, None] != rows["id"]), v[:50] @ v.T, -np.inf)
    assert (best.scores[:, 0] == -np.sort(-scores, axis=1)[:, :5]).all()
    assert sum(exact) < 50 * 2000 / 3 / 4

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ablatrix.functions import arrays as ar, naming, numeric, permutation
from ablatrix.functions.hashing import order_hash
from ablatrix.operators import corpus


def _floats():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2**31, 4000, dtype=np.uint32)
    vals = np.concatenate([bits.view(np.float32), rng.standard_normal(2000).astype(np.float32)])
    edge = [0.0, -0.0, 1.0, -1.0, 2**-126, 2**-149, 3 * 2**-149, 1 - 2**-24, 2 - 2**-23, 3.4e38, np.inf, -np.inf]
    vals = np.concatenate([vals[np.isfinite(vals)], np.array(edge, np.float32)])
    return vals


def _column(spark, values, kernel):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    rows = df.withColumn("v", F.col("v").cast("float")).withColumn("y", kernel(F.col("v"))).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_bf16_matches_bit_rounding(spark):
    vals = _floats()
    bits = vals.view(np.uint32).astype(np.uint64)
    half = ((bits >> 16) & 1) + 0x7FFF
    want = (((bits + half) >> 16) << 16).astype(np.uint32).view(np.float32)
    got = np.array(_column(spark, vals, numeric.round_bf16), np.float32)
    assert np.array_equal(got, want)


def test_bf16_keeps_nan(spark):
    assert np.isnan(_column(spark, [float("nan")], numeric.round_bf16)[0])


def test_magnitude_key_orders_like_magnitude(spark):
    vals = _floats()
    keys = np.array(_column(spark, vals, numeric.magnitude_key), np.int64)
    assert keys.min() >= 0 and keys.max() < 2**32
    order = np.argsort(np.abs(vals), kind="stable")
    a, k = np.abs(vals)[order], keys[order]
    assert np.array_equal(a[1:] > a[:-1], k[1:] > k[:-1])


@pytest.mark.parametrize("k, label", [(0.00256, "0.00256"), (0.00001, "0.00001"), (10.0, "10"), (0.5, "0.5")])
def test_format_k(spark, k, label):
    assert spark.range(1).select(numeric.format_k(F.lit(k))).first()[0] == label


def test_names(spark):
    df = spark.createDataFrame([("module.model.layers.12.mlp.up.weight.pt",), ("model.norm.weight",)], "t string")
    t = F.col("t")
    rows = df.select(naming.layer_of(t), naming.is_mlp(t), naming.file_safe(t), naming.strip_module(t)).collect()
    assert tuple(rows[0]) == (12, True, "module_model_layers_12_mlp_up_weight", "model.layers.12.mlp.up.weight.pt")
    assert tuple(rows[1]) == (None, False, "model_norm_weight", "model.norm.weight")


def test_attention_golden(spark):
    df = spark.createDataFrame([([5, 9, 2, 4, 2],)], "a array<int>")
    mask = ar.valid_positions(ar.pad_right(F.col("a"), 8, 2), 2)
    assert df.select(mask.alias("m")).first()["m"] == [True] * 4 + [False] * 4


def test_attention_without_pad(spark):
    df = spark.createDataFrame([([5, 9],)], "a array<int>")
    assert df.select(ar.valid_positions(F.col("a"), 2).alias("m")).first()["m"] == [True, True]


def test_greedy_packing_against_loop(spark):
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 9, rng.integers(0, 30)).tolist() for _ in range(200)]
    pieces = [[[7] * n for n in sizes] for sizes in lists]

    def loop(sizes, limit):
        out, total, opened = [], 0, False
        for n in sizes:
            if opened and total + n > limit:
                out.append(total)
                total = 0
            total += n
            opened = True
        return [n for n in out + [total] if n]

    df = spark.createDataFrame(list(enumerate(pieces)), "i int, ids array<array<int>>")
    greedy = corpus.segments_of(df, 8, "greedy").select("i", F.transform("segments", F.size).alias("g"))
    rows = df.join(greedy, "i").orderBy("i").select(
        "g", F.transform(ar.pack_or_drop(F.col("ids"), 8), F.size).alias("d"),
    ).collect()
    for sizes, row in zip(lists, rows):
        want = loop(sizes, 8)
        assert row["g"] == want
        assert row["d"] == (want if len(want) == 1 else [])


def test_long_sentences_are_cut():
    sentences = pa.array([[[1] * 3], [[2] * 10, [3] * 2], [], [[], [4]]], pa.list_(pa.list_(pa.int32())))
    assert ar.pack_greedy(sentences, 4).to_pylist() == [[[1] * 3], [[2] * 4, [2] * 4, [2, 2, 3, 3]], [], [[4]]]
    assert ar.pack_greedy(sentences.slice(1, 2), 4).to_pylist() == [[[2] * 4, [2] * 4, [2, 2, 3, 3]], []]


def test_packing_takes_time_by_length_only():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 40, 200_000)
    begin = time.perf_counter()
    ends = ar.greedy_ends(sizes, 512)
    assert time.perf_counter() - begin < 1
    lengths = np.diff([0, *ends])
    assert lengths.max() <= 512 and lengths.sum() == sizes.sum() and (lengths[:-1] > 512 - 40).all()


def test_prefix_sums(spark):
    df = spark.createDataFrame([(0, [3, 1, 2]), (1, []), (2, [5])], "i int, n array<int>").coalesce(1)
    assert [r["s"] for r in df.select("i", ar.prefix_sums("n").alias("s")).orderBy("i").collect()] == [[0, 3, 4], [], [0]]


def test_dense_mask(spark):
    df = spark.createDataFrame([(0, [1, 3], 5), (1, [], 2), (2, None, 2), (3, [0, 1], 2)], "i int, h array<int>, n int")
    rows = df.orderBy("i").select(ar.dense_mask(F.col("h"), F.col("n")).alias("m")).collect()
    assert [r["m"] for r in rows] == [
        [False, True, False, True, False], [False, False], [False, False], [True, True],
    ]


def test_order_hash_depends_on_identity_only(spark):
    df = spark.range(100).withColumn("h", order_hash(1, F.col("id")))
    one = {r["id"]: r["h"] for r in df.repartition(1).collect()}
    assert one == {r["id"]: r["h"] for r in df.repartition(7).collect()}
    assert min(one.values()) >= 0 and max(one.values()) < 2**60 and len(set(one.values())) == 100


def test_percentages_round_by_their_exact_value(spark):
    pairs = [(n, m) for m in (7, 8, 400, 800, 20_000, 99_991) for n in range(0, m + 1, max(1, m // 400))] + [(203, 20_000)]
    df = spark.createDataFrame(pairs, "n long, m long")
    for r in df.withColumn("p", numeric.two_decimals(F.col("n") / F.col("m") * 100)).collect():
        assert r["p"] == float(f"{r['n'] / r['m'] * 100:.2f}"), r


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 4096, 4097, 100_003])
def test_permutation(n):
    for seed in (0, 11):
        ranks = permutation.permuted(np.arange(n), n, seed)
        assert (np.sort(ranks) == np.arange(n)).all()
    if n > 4000:
        near = np.abs(np.diff(ranks))  # neighbours are thrown apart, and halves mixed
        assert near.mean() > n / 5 and abs((ranks[: n // 2] < n // 2).mean() - 0.5) < 0.05
        assert (ranks != permutation.permuted(np.arange(n), n, 0)).mean() > 0.99


def test_permutation_of_large_ranges():
    n = 10**13 + 37
    x = np.unique(np.random.default_rng(1).integers(0, n, 50_000))
    ranks = permutation.permuted(x, n, 5)
    assert len(np.unique(ranks)) == len(x) and ranks.min() >= 0 and ranks.max() < n


@pytest.mark.parametrize("n", [1, 5, 1000, 10**13 + 37])
def test_permutation_as_an_expression(spark, n):
    x = sorted({int(i) for i in np.random.default_rng(2).integers(0, n, 300)} | {0, n - 1})
    df = spark.createDataFrame([(i,) for i in [*x, -1, n]], "x long")
    got = {r["x"]: r["r"] for r in df.select("x", permutation.permuted_column(F.col("x"), n, 7).alias("r")).collect()}
    assert got == dict(zip(x, permutation.permuted(np.array(x), n, 7).tolist())) | {-1: None, n: None}

"""Running sums, ranks and selection: skewed, sparse and tied inputs against brute force, and
the same results under any partitioning."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ablatrix.operators import attribution, damage, done, masks, packing, ranks, region
from ablatrix.operators.running import hash_levels, hashed_rank, id_levels, running_sums
from ablatrix.operators.splitting import split_exact
from ablatrix.session import settle


def _brute_sums(rows):
    """rows: (group, id, n) -> (group, id) -> (ids before, n before)."""
    out, seen = {}, defaultdict(lambda: [0, 0])
    for g, i, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out[g, i] = tuple(seen[g])
        seen[g][0] += 1
        seen[g][1] += n
    return out


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("kind", ["dense", "sparse", "clustered"])
def test_running_sums(spark, parts, kind):
    rng = np.random.default_rng(1)
    n = 3000
    ids = {
        "dense": np.arange(n),
        "sparse": np.unique(rng.integers(-(2**62), 2**62, n)),
        "clustered": np.unique(np.concatenate([rng.integers(0, 2**20, n // 2), 2**45 + rng.integers(0, 2**20, n // 2)])),
    }[kind]
    # A third of the rows in one group, some in the null group.
    groups = ["hot" if x < 0.34 else None if x < 0.4 else f"g{int(x * 50)}" for x in rng.random(len(ids))]
    rows = [(g, int(i), int(v)) for g, i, v in zip(groups, ids, rng.integers(0, 9, len(ids)))]
    df = spark.createDataFrame(rows, "g string, i long, n int").repartition(parts)
    sums = {"at": F.lit(1), "before": F.col("n")}
    got = running_sums(df, ["i"], id_levels("i"), sums, by=["g"]).collect()
    assert {(r["g"], r["i"]): (r["at"], r["before"]) for r in got} == _brute_sums(rows)
    assert len(got) == len(rows)
    whole = running_sums(df, ["i"], id_levels("i"), sums).collect()
    assert {(None, r["i"]): (r["at"], r["before"]) for r in whole} == _brute_sums([(None, i, n) for _, i, n in rows])


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, "x") for i in range(10)], "id long, payload string")
    plan = running_sums(df, ["id"], id_levels("id"), {"at": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(__level0" in line]
    assert plan.count("Exchange SinglePartition") <= 1 and len(wide) >= 1
    payload_exchanges = [x for x in plan.split("Exchange hashpartitioning")[1:] if x.splitlines()[1].count("payload")]
    assert len(payload_exchanges) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_hashed_rank_is_dense(spark, parts):
    df = spark.range(500).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(2**60))).repartition(parts)
    rows = hashed_rank(df, "h", "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rank"])] == [r["id"] for r in sorted(rows, key=lambda r: (r["h"], r["id"]))]
    assert sorted(r["rank"] for r in rows) == list(range(500))
    assert len(hash_levels("h")) == 2


def test_bounds_with_ties_over_several_position_blocks(spark):
    """Half of all rows share one key, and their positions lie in many blocks."""
    rng = np.random.default_rng(2)
    rows = [("a", int(5 if x < 0.5 else rng.integers(0, 2**32)), i * 300_000) for i, x in enumerate(rng.random(400))]
    rows += [("b", 7, i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, key long, pos long")
    wanted = [("a", r, far) for r in (1, 57, 203, 300, 400, 999) for far in (False, True)]
    wanted += [("b", r, far) for r in (1, 20, 50) for far in (False, True)]
    asked = spark.createDataFrame(wanted, "g string, rank long, far boolean")
    bounds, local = ranks.locate_bounds(ranks.count_rows(df), asked, ["g"])
    assert len(local) == len(wanted)
    bounds = bounds.withColumnRenamed("g", "bg")
    inside = ranks.within(F.col("key"), F.col("pos"), F.col("at_key"), F.col("at_pos"), F.col("far"))
    hit = df.join(bounds, (F.col("g") == F.col("bg")) & inside).select("g", "rank", "far", "key", "pos").collect()
    got = defaultdict(set)
    for r in hit:
        got[r["g"], r["rank"], r["far"]].add((r["key"], r["pos"]))
    for g, rank, far in wanted:
        order = sorted([(k, p) for gg, k, p in rows if gg == g], key=lambda x: (-x[0], x[1]))
        want = order[-rank:] if far else order[:rank]
        assert got[g, rank, far] == set(want), (g, rank, far)


def test_settle_beyond_its_bounds(spark):
    table, rows = settle(spark.range(100), max_rows=10)
    assert rows is None and table.count() == 100
    table, rows = settle(spark.range(10), max_rows=10)
    assert len(rows) == 10 and table.count() == 10


SIZE = 16


def _tensors(spark, ties):
    """Three checkpoints, one with damage in its name; with ``ties`` a third of all values are zero."""
    rng = np.random.default_rng(9)
    names = ["model.embed.weight", "model.norm.weight"] + [
        f"model.layers.{layer}.{part}.weight" for layer in range(12) for part in ("mlp.up", "self_attn.q", "MLP.down")
    ]
    rows, flat = [], {}
    for ckpt in ("checkpoint_1", "checkpoint_2", "checkpoint_2_damage"):
        for name in names:
            shape = [int(rng.integers(1, 12)), int(rng.integers(1, 12))]
            numel = shape[0] * shape[1]
            vals = rng.standard_normal(numel).astype(np.float32)
            if ties:
                vals = np.round(vals * 2) / 2
                vals[rng.random(numel) < 0.34] = 0
            flat[ckpt, name] = vals
            for b in range(0, numel, SIZE):
                rows.append((ckpt, name, shape, b // SIZE, [float(x) for x in vals[b : b + SIZE]]))
    df = spark.createDataFrame(rows, "ckpt string, tensor string, shape array<int>, block long, vals array<float>")
    return df, flat


def _brute_selection(flat, ks, front, back, mode, floor):
    out = {}
    for ckpt in sorted({c for c, _ in flat}):
        mine = {t: v for (c, t), v in flat.items() if c == ckpt}
        total = sum(len(v) for v in mine.values())
        layer = {t: int(t.split(".")[2]) for t in mine if t.startswith("model.layers")}
        n_layers = max(layer.values()) + 1
        chosen = [t for t in layer if "mlp" in t.lower() and front <= layer[t] < n_layers - back]
        chosen.sort(key=lambda t: (layer[t], t))
        where = [(t, i) for t in chosen for i in range(len(mine[t]))]
        vals = np.concatenate([np.abs(mine[t]) for t in chosen])
        for k in ks:
            budget = math.floor(k * total)
            if len(vals) < budget:
                continue
            fraction = budget / len(vals)
            size = max(floor, int(math.sqrt(len(vals) / (fraction + 1e-9)))) if mode == "chunked" else len(vals)
            for start in range(0, len(vals), size):
                part = range(start, min(start + size, len(vals)))
                take = max(1, math.ceil(fraction * len(part))) if mode == "chunked" else budget
                top = sorted(part, key=lambda g: (-vals[g], g))[:take]
                bottom = sorted(part, key=lambda g: (vals[g], -g))[:take]
                out.setdefault((ckpt, k, "top"), set()).update(where[g] for g in top)
                out.setdefault((ckpt, k, "bottom"), set()).update(where[g] for g in bottom)
    return {key: v for key, v in out.items() if v}


@pytest.mark.parametrize("whole_blocks", [False, True])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("mode", ["global", "chunked"])
def test_selection_against_brute_force(spark, ties, mode, whole_blocks):
    df, flat = _tensors(spark, ties)
    ks = [0.0001, 0.004, 0.1, 0.9]
    meta = region.layout(df, front=1, back=2)
    if mode == "global":
        picked = region.select_global(df, meta, ks, SIZE, whole_blocks=whole_blocks)
    else:
        picked = region.select_chunked(df, meta, ks, SIZE, chunk_floor=100, whole_blocks=whole_blocks)
    got = defaultdict(set)
    rows = picked.collect()
    for r in rows:
        got[r["ckpt"], r["k"], r["side"]].add((r["tensor"], r["pos"]))
    want = _brute_selection(flat, ks, 1, 2, mode, 100)
    assert dict(got) == want
    assert len(rows) == sum(len(v) for v in want.values())


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_selection_ignores_partitioning(spark, parts):
    df, _ = _tensors(spark, True)
    key = ["ckpt", "k", "side", "tensor", "pos"]
    one = region.select_global(df, region.layout(df), [0.05], SIZE).select(key).collect()
    again = df.repartition(parts)
    two = region.select_global(again, region.layout(again), [0.05], SIZE).select(key).collect()
    assert sorted(one) == sorted(two)


def test_all_values_equal_keeps_sides_apart(spark):
    rows = [("c", "model.layers.0.mlp.w", [100], b, [1.0] * 10) for b in range(10)]
    df = spark.createDataFrame(rows, "ckpt string, tensor string, shape array<int>, block long, vals array<float>")
    picked = region.select_global(df, region.layout(df), [0.5], 10).collect()
    sides = {s: {r["pos"] for r in picked if r["side"] == s} for s in ("top", "bottom")}
    assert sides == {"top": set(range(50)), "bottom": set(range(50, 100))}


def test_nan_is_left_out_and_counted(spark):
    rows = [("c", "model.layers.0.mlp.w", [4], 0, [float("nan"), 3.0, float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "ckpt string, tensor string, shape array<int>, block long, vals array<float>")
    picked = region.select_global(df, region.layout(df), [0.5], 4, ["top"]).collect()
    assert {r["pos"] for r in picked} == {1, 2}
    assert region.nan_counts(df).first()["n_nan"] == 1


def test_last_pass_is_a_filter(spark):
    df, _ = _tensors(spark, True)
    plan = region.select_global(df, region.layout(df), [0.05], SIZE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan and "CartesianProduct" not in plan


def test_preview_limits_before_the_shuffle(spark):
    df, _ = _tensors(spark, False)
    meta = region.layout(df)
    picked = region.select_global(df, meta, [0.05], SIZE)
    assert "WindowGroupLimit" in region.selected_preview(picked, meta, [0.05])._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("group", [3, 1024])
def test_damage_zeroes_selected_places_only(spark, group, monkeypatch):
    monkeypatch.setattr(damage, "VARIANT_GROUP", group)
    df, flat = _tensors(spark, False)
    one = df.filter("ckpt = 'checkpoint_1'")
    weights = one.select("tensor", "shape", "block", F.col("vals").alias("weight"))
    picked = region.select_chunked(df, region.layout(df), [0.01, 0.2], SIZE, chunk_floor=100)
    rows = damage.damage_variants(weights, picked, SIZE).collect()
    chosen = defaultdict(set)
    for r in picked.collect():
        chosen[r["ckpt"], r["k"], r["side"], r["tensor"]].add(r["pos"])
    variants = {(r["ckpt"], r["k"], r["side"]) for r in rows}
    assert len(variants) == 12 and len(rows) == 12 * weights.count()
    for r in rows:
        hit = chosen[r["ckpt"], r["k"], r["side"], r["tensor"]]
        base = flat["checkpoint_1", r["tensor"]]
        for i, w in enumerate(r["weight"]):
            pos = r["block"] * SIZE + i
            assert w == (0.0 if pos in hit else float(base[pos]))


def test_no_variants_without_both_sides(spark):
    df, _ = _tensors(spark, False)
    weights = df.filter("ckpt = 'checkpoint_1'").select("tensor", "shape", "block", F.col("vals").alias("weight"))
    picked = region.select_global(df, region.layout(df), [0.05], SIZE, ["top"])
    assert damage.damage_variants(weights, picked, SIZE).count() == 0


def test_mask_shapes(spark):
    params = [("a.w", [4, 2]), ("b.w", [4, 2]), ("c.w", [4, 2]), ("d.w", [8]), ("e.w", [4, 3])]
    masks = [("a.w", [4, 2]), ("b.w", [3, 2]), ("c.w", [6, 2]), ("d.w", [4, 2]), ("e.w", [4, 2])]
    schema = "tensor string, shape array<int>"
    report = damage.shape_report(spark.createDataFrame(params, schema), spark.createDataFrame(masks, schema))
    assert {r["tensor"]: r["status"] for r in report.collect()} == {
        "a.w": "equal", "b.w": "pad", "c.w": "cut", "d.w": "rank", "e.w": "inner",
    }
    selection = spark.createDataFrame([("c.w", 7), ("c.w", 8), ("b.w", 5)], "tensor string, pos long")
    with pytest.raises(ValueError):
        damage.repair(selection, report)
    usable = report.filter("status not in ('rank', 'inner')")
    assert sorted(map(tuple, damage.repair(selection, usable).select("tensor", "pos").collect())) == [("b.w", 5), ("c.w", 7)]


def test_split_exact(spark):
    for n in (1, 7, 1000):
        counts = {r["split"]: r["count"] for r in split_exact(spark.range(n), "id").groupBy("split").count().collect()}
        assert counts.get("test", 0) == math.ceil(0.2 * n) and sum(counts.values()) == n


def _packed(spark, lengths, source=0):
    rows, start = [], 0
    for i, n in enumerate(lengths):
        rows.append((i, start, n, [source] * n))
        start += n
    return spark.createDataFrame(rows, "sample_id long, start long, length int, tokens array<int>")


def test_merge_and_integrity(spark):
    lengths = [[3, 1, 4], [1], [5, 9, 2, 6], []]
    parts = [_packed(spark, x, i) for i, x in enumerate(lengths)]
    merged = packing.merge_datasets(parts).orderBy("sample_id").collect()
    assert [r["length"] for r in merged] == [3, 1, 4, 1, 5, 9, 2, 6]
    assert [r["start"] for r in merged] == np.cumsum([0, 3, 1, 4, 1, 5, 9, 2]).tolist()
    typed = packing.merge_datasets(parts, [7, 2, 7, 2])
    rows = typed.orderBy("sample_id").collect()
    assert [(r["type"], r["length"]) for r in rows] == [(7, 3), (7, 1), (7, 4), (7, 5), (7, 9), (7, 2), (7, 6), (2, 1)]
    assert {r["type"]: r["n_samples"] for r in packing.manifest(typed).collect()} == {7: 7, 2: 1}
    assert packing.integrity_violations(typed, total_tokens=31, n_samples=8).count() == 0
    assert packing.integrity_violations(typed, total_tokens=30).count() == 1
    gap = typed.filter("sample_id <> 3")
    assert {(r["sample_id"], r["problem"]) for r in packing.integrity_violations(gap).collect()} == {(2, "gap"), (None, "totals")}


def test_integrity_sees_seams_between_blocks(spark):
    n = 2**16
    df = spark.range(n - 2, n + 2).select(
        F.col("id").alias("sample_id"), F.col("id").alias("start"), F.lit(1).alias("length")
    )
    seam = df.withColumn("start", F.when(F.col("sample_id") >= n, F.col("start") + 1).otherwise(F.col("start")))
    assert [r["sample_id"] for r in packing.integrity_violations(seam).filter("problem = 'gap'").collect()] == [n - 1]
    assert packing.integrity_violations(df).filter("problem = 'gap'").count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 65_536, 70_000])
def test_mask_containers(size):
    rng = np.random.default_rng(size)
    kinds = set()
    for share in (0, 0.001, 0.1, 0.4, 1):
        places = np.flatnonzero(rng.random(size) < share)
        kind, data = masks.encode(places)
        assert (masks.decode(kind, data) == places).all()
        kinds.add(kind.rstrip("24"))
        assert len(data) <= size // 8 + 1
    runs = np.concatenate([np.arange(0, size // 3), np.arange(size // 2, size)])
    assert (masks.decode(*masks.encode(runs)) == runs).all()
    assert size < 1000 or kinds == {"array", "bitmap", "run"}


def _two_by_two(spark):
    return spark.createDataFrame([("m.w", [2, 2], 0, [1.0, 2.0, 3.0, 4.0])], "tensor string, shape array<int>, block long, weight array<float>")


@pytest.mark.parametrize("shape,want", [([2, 2], [0.0, 2.0, 0.0, 4.0]), ([1, 2], [0.0, 2.0, 0.0, 4.0]), ([5, 2], [0.0, 2.0, 0.0, 4.0]),
                                        ([4], None), ([2, 3], None), ([1, 2, 2], None)])
def test_shape_rules_when_masks_are_applied(spark, shape, want):
    chosen = [("c", 0.1, side, "m.w", p) for side in ("top", "bottom") for p in (0, 2, 9)]
    selection = spark.createDataFrame(chosen, "ckpt string, k double, side string, tensor string, pos long")
    shapes = spark.createDataFrame([("m_w", shape)], "tensor string, shape array<int>")
    one = damage.apply_mask(_two_by_two(spark), selection.filter("side = 'top'"), 4, shapes)
    both = damage.damage_variants(_two_by_two(spark), damage.mask_containers(selection, 4), 4, shapes)
    if want is None:
        for df in (one, both):
            with pytest.raises(Exception, match="mask of m.w does not match its parameter"):
                df.select("tensor").collect()
    else:
        assert [r["weight"] for r in one.collect()] == [want]
        assert [r["weight"] for r in both.collect()] == [want] * 2


def test_unusable_masks_without_a_place(spark):
    nothing = spark.createDataFrame([], "ckpt string, k double, side string, tensor string, pos long")
    shapes = spark.createDataFrame([("m.w", [4])], "tensor string, shape array<int>")
    assert damage.apply_mask(_two_by_two(spark), nothing, 4).first()["weight"] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(Exception, match="rank"):
        damage.apply_mask(_two_by_two(spark), nothing, 4, shapes).collect()


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_sums_have_the_same_bits(spark, parts):
    rng = np.random.default_rng(8)
    rows = [(t, b, int(k), (rng.standard_normal(50) * 10.0 ** rng.integers(-6, 6)).astype(np.float32).tolist())
            for t in ("a", None) for b in range(3) for k in [*range(-5, 40), 300, 70_000] for _ in range(1 + (k == 7))]
    df = spark.createDataFrame(rows, "tensor string, block long, batch long, grad array<float>").repartition(parts)

    def tree(values):
        values = {k: sorted(v, key=lambda x: x.tobytes()) for k, v in values.items()}
        for _ in range(5):
            up = defaultdict(list)
            for k in sorted(values):
                for x in values[k]:
                    up[k >> 4].append(x)
            values = {k: [sum(v, np.zeros(50))] for k, v in up.items()}
        return values[0][0]

    total, mean = (attribution.accumulate(df, how).collect() for how in ("sum", "mean"))
    for got, n in ((total, 1), (mean, 48)):
        assert len(got) == 6
        for r in got:
            own = defaultdict(list)
            for t, b, k, g in rows:
                if (t, b) == (r["tensor"], r["block"]):
                    own[k + 5].append(np.array(g, np.float64))
            assert np.array_equal(np.array(r["grad"], np.float32), (tree(own) / n).astype(np.float32))


def test_blocks_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([("a", 0, 0, [1.0]), ("a", 0, 1, [1.0, 2.0])], "tensor string, block long, batch long, grad array<float>")
    with pytest.raises(Exception, match="differ in size"):
        attribution.accumulate(df).collect()
    assert attribution.accumulate(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["text", "negative", "repeated", "equal rows", "nulls"])
def test_exact_splits_of_any_keys(spark, kind):
    key = {"text": lambda i: f"k{i}", "negative": lambda i: str(-i), "repeated": lambda i: str(i % 3), "equal rows": lambda i: "x", "nulls": lambda i: None if i % 2 else str(i)}[kind]
    rows = [(key(i), 0 if kind == "equal rows" else i) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, v int")
    for by in ("k", None):
        got = [tuple(r) for r in split_exact(df.repartition(4), by).collect()]
        assert sorted(map(repr, (r[:2] for r in got))) == sorted(map(repr, rows))
        assert sum(r[2] == "test" for r in got) == 101
        assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in split_exact(df.repartition(1), by).collect())))


def test_done_filter(spark, tmp_path):
    keys = [(f"k{i}", i % 5 if i % 7 else None) for i in range(4000)]
    seen = keys[:3000] + keys[:50] + [(None, None), (None, 3)]
    df = spark.createDataFrame(keys + [(None, None), (None, 4)] + keys[2990:3010], "a string, b int").repartition(3)
    old = spark.createDataFrame(seen, "a string, b int").repartition(4)
    first, second = old.filter("a < 'k2'"), old.filter("a >= 'k2' or a is null")
    merged = done.merge_filters(done.build_filter(first, ["a", "b"], 100_000), done.build_filter(second, ["a", "b"]))
    done.write_filter(merged, str(tmp_path / "filter"))
    bloom = done.read_filter(spark, str(tmp_path / "filter"))
    probed = done.with_probe(df, bloom, ["a", "b"]).collect()
    assert len(probed) == df.count()
    known = set(seen)
    assert all(r["maybe_done"] for r in probed if (r["a"], r["b"]) in known)  # nothing done is taken for new
    fresh = [r for r in probed if (r["a"], r["b"]) not in known]
    assert sum(r["maybe_done"] for r in fresh) < 0.05 * len(fresh)
    want = sorted(map(repr, (tuple(r) for r in df.collect() if tuple(r) not in known)))
    for how in (bloom, None):
        assert sorted(map(repr, map(tuple, done.not_done(df, old, ["a", "b"], how).collect()))) == want
    assert done.not_done(df, old, ["a", "b"], done.build_filter(old.limit(0), ["a", "b"])).count() == df.count()
    # Without a hit the done keys are not even read.
    unread = spark.createDataFrame([("zz", 1)], "a string, b int")
    plan = done.not_done(unread, old, ["a", "b"], bloom)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_blocks_of_a_wrong_size_are_refused(spark):
    shape = [4, 4]
    blocks = [("c", "model.layers.0.mlp.w", shape, b, [1.0] * n) for b, n in ((0, 8), (1, 7))]
    df = spark.createDataFrame(blocks, "ckpt string, tensor string, shape array<int>, block long, vals array<float>")
    with pytest.raises(Exception, match="block 1 of model.layers.0.mlp.w has 7 values, not 8"):
        region.select_random(df, region.layout(df), [0.5], 0, 8).collect()
    with pytest.raises(Exception, match="values, not"):
        region.select_global(df, region.layout(df), [0.5], 16).collect()

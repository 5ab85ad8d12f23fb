"""Region extraction: exact top and bottom fractions of attribution magnitudes in MLP layers.

Input is a block table (ckpt, tensor, shape, block, vals) and its ``layout``. Element ``i`` of block ``b`` is flat
position ``b * block_size + i`` of its tensor. Across a checkpoint, eligible tensors are laid end to
end in (layer, tensor) order; ``gpos`` is the position there and breaks ties, first one
first at the top and last one first at the bottom.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import naming, numeric
from ..functions.numeric import format_k, magnitude_key
from ..session import settle
from . import blocks as bk
from .ranks import count_rows, locate_bounds, within

BLOCK_SIZE = 65_536
# Least number of elements in a chunk, and the guard against division by zero.
CHUNK_FLOOR = 1_000_000
CHUNK_EPSILON = 1e-9
SIDES = ("top", "bottom")


def usable_checkpoints(df: DataFrame) -> DataFrame:
    """Checkpoints that are not themselves damaged ones, as evaluations are queued for."""
    return df.filter(~naming.is_damaged_checkpoint(F.col("ckpt")))


def tensor_meta(blocks: DataFrame) -> DataFrame:
    """One row per tensor: ``shape``, ``numel`` and ``layer``. Reads no values."""
    numel = F.aggregate("shape", F.lit(1).cast("bigint"), lambda n, d: n * d)
    return (
        blocks.groupBy("ckpt", "tensor")
        .agg(F.max("shape").alias("shape"))
        .withColumns({"numel": numel, "layer": naming.layer_of(F.col("tensor"))})
    )


def with_eligibility(meta: DataFrame, front: int = 0, back: int = 0) -> DataFrame:
    """Add ``n_layers`` of the checkpoint and whether the tensor takes part: an MLP tensor that is
    not among the first ``front`` or last ``back`` layers."""
    n_layers = F.coalesce(F.max("layer").over(Window.partitionBy("ckpt")) + 1, F.lit(0))
    inside = F.col("layer").between(F.lit(front), F.col("n_layers") - back - 1)
    return meta.withColumn("n_layers", n_layers).withColumn(
        "eligible", F.coalesce(naming.is_mlp(F.col("tensor")) & inside, F.lit(False))
    )


def with_offsets(meta: DataFrame) -> DataFrame:
    """Add where each eligible tensor starts in its checkpoint's laid-out elements; null for others."""
    w = (
        Window.partitionBy("ckpt")
        .orderBy(F.col("eligible").desc(), "layer", "tensor")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("numel").over(w), F.lit(0).cast("bigint"))
    return meta.withColumn("offset", F.when(F.col("eligible"), before))


def masked_tensors(meta: DataFrame) -> DataFrame:
    """Tensors that get a mask: those of numbered layers, whether or not anything is selected there."""
    return meta.filter(F.col("layer").isNotNull()).select("ckpt", "tensor")


def layout(blocks: DataFrame, front: int = 0, back: int = 0) -> DataFrame:
    """Metadata with eligibility and offsets, evaluated once."""
    return settle(with_offsets(with_eligibility(tensor_meta(blocks), front, back)))[0]


def budgets(meta: DataFrame, ks: Sequence[float], chunk_floor: int = CHUNK_FLOOR) -> DataFrame:
    """Per checkpoint and k: how many elements to take, as which fraction, in chunks of which size.

    Checkpoints without eligible elements, or with fewer than asked for, have no row.
    """
    totals = meta.groupBy("ckpt").agg(
        F.sum("numel").alias("total"),
        F.coalesce(F.sum(F.when(F.col("eligible"), F.col("numel"))), F.lit(0).cast("bigint")).alias("mlp_total"),
    )
    share = F.col("budget") / F.col("mlp_total")
    size = F.sqrt(F.col("mlp_total") / (F.col("fraction") + CHUNK_EPSILON))
    return (
        totals.withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))
        .withColumn("budget", F.floor(F.col("k") * F.col("total")).cast("bigint"))
        .filter((F.col("mlp_total") > 0) & (F.col("mlp_total") >= F.col("budget")))
        .withColumn("fraction", share)
        .withColumn("chunk_size", F.greatest(F.lit(chunk_floor), size.cast("bigint")).cast("bigint"))
    )


def positioned(blocks: DataFrame, meta: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks of eligible tensors: ckpt, tensor, pos and gpos of the first element, vals."""
    lookup = meta.filter("eligible").select("ckpt", "tensor", "offset", "numel")
    first = F.col("block") * block_size
    # A block of another size would put all elements behind it in wrong places.
    due = F.greatest(F.lit(0), F.least(F.lit(block_size), F.col("numel") - first))
    message = F.concat(F.lit("block "), F.col("block"), F.lit(" of "), F.col("tensor"), F.lit(" has "), F.size("vals"), F.lit(" values, not "), due)
    return (
        blocks.select("ckpt", "tensor", "block", "vals")
        .join(lookup, ["ckpt", "tensor"])
        .withColumn("vals", F.when(F.size("vals") == due, F.col("vals")).otherwise(F.raise_error(message)))
        .select("ckpt", "tensor", first.alias("pos"), (F.col("offset") + first).alias("gpos"), "vals")
    )


def elements_of(placed: DataFrame) -> DataFrame:
    """Positioned blocks as one row per element; NaN values are left out."""
    return (
        placed.select("ckpt", "tensor", "pos", "gpos", F.posexplode("vals").alias("i", "val"))
        .filter(~F.isnan("val"))
        .select("ckpt", "tensor", (F.col("pos") + F.col("i")).alias("pos"), (F.col("gpos") + F.col("i")).alias("gpos"), "val")
    )


def nan_counts(blocks: DataFrame) -> DataFrame:
    """Values the selection has to leave out, per tensor."""
    n = F.size(F.filter("vals", lambda v: F.isnan(v)))
    return blocks.groupBy("ckpt", "tensor").agg(F.sum(n).alias("n_nan")).filter("n_nan > 0")


def _pick_rows(elements: DataFrame, bounds: DataFrame, groups: list[str]) -> DataFrame:
    """Elements (with ``key``) within one of the bounds of their group."""
    bounds = bounds.withColumnsRenamed({g: f"__{g}" for g in groups})
    same_group = reduce(lambda a, b: a & b, [elements[g] == bounds[f"__{g}"] for g in groups])
    inside = within(elements["key"], elements["gpos"], bounds["at_key"], bounds["at_pos"], bounds["far"])
    return elements.join(bounds, same_group & inside).select(
        "ckpt", "k", "side", "tensor", "pos", "gpos", "val", "chunk"
    )


def _wanted(cells: DataFrame, groups: list[str]) -> DataFrame:
    return cells.filter("take > 0").select(
        *groups, "k", "side", F.col("take").alias("rank"), (F.col("side") == "bottom").alias("far")
    )


def _pick(
    placed: DataFrame, cells: DataFrame, groups: list[str], sizes: list[dict] | None, elements: DataFrame,
) -> DataFrame:
    """Elements under one of the ``cells`` (groups, k, side, take).

    Counting and picking run on whole blocks as long as what a task must know (chunk sizes,
    prefixes, bounds) is a checked small table; past that, on ``elements``, by joins.
    """
    by_rows = count_rows(elements.select(*groups, "key", F.col("gpos").alias("pos")))
    plan: dict[str, list[int | None]] = {}
    for row in sizes or []:
        plan.setdefault(row["ckpt"], []).append(row["chunk_size"])

    def count(into: str, prefix: list[str], found: DataFrame | None, local: list | None) -> DataFrame:
        if sizes is None or (found is not None and local is None):
            return by_rows(into, prefix, found, local)
        return bk.digit_counts(placed, plan, prefix, into, groups, local if found is not None else None)

    longest = max((row["mlp_total"] for row in sizes or []), default=2**62)
    bounds, local = locate_bounds(count, _wanted(cells, groups), groups, longest)
    if sizes is None or local is None:
        return _pick_rows(elements, bounds, groups)
    return bk.picked(placed, plan, groups, local)


def select_global(
    blocks: DataFrame, meta: DataFrame, ks: Sequence[float], block_size: int = BLOCK_SIZE,
    sides: Sequence[str] = SIDES, whole_blocks: bool = True,
) -> DataFrame:
    """Exactly floor(k * total) largest and smallest magnitudes per checkpoint; all k at once.

    Rows (ckpt, k, side, tensor, pos, gpos, val, chunk); ``chunk`` is 0.
    """
    plan = budgets(meta, ks)
    cells = plan.select(
        "ckpt", "k", F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"), F.col("budget").alias("take")
    )
    placed = positioned(blocks, meta, block_size)
    elements = elements_of(placed).withColumns(
        {"key": magnitude_key(F.col("val")), "chunk": F.lit(0).cast("bigint")}
    )
    sizes = None
    if whole_blocks:
        _, sizes = settle(plan.select("ckpt", F.lit(None).cast("bigint").alias("chunk_size"), "mlp_total").distinct())
    return _pick(placed, cells, ["ckpt"], sizes, elements)


def select_chunked(
    blocks: DataFrame, meta: DataFrame, ks: Sequence[float], block_size: int = BLOCK_SIZE,
    sides: Sequence[str] = SIDES, chunk_floor: int = CHUNK_FLOOR, whole_blocks: bool = True,
) -> DataFrame:
    """Largest and smallest magnitudes chunk by chunk: max(1, ceil(fraction * chunk)) from each.

    A chunk is a run of consecutive gpos; its size depends on k, so elements are counted once per
    distinct size, not once per k.
    """
    plan = budgets(meta, ks, chunk_floor)
    in_chunk = F.least(F.col("chunk_size"), F.col("mlp_total") - F.col("chunk") * F.col("chunk_size"))
    cells = (
        plan.withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides])))
        .withColumn("chunk", F.explode(F.expr("sequence(0L, (mlp_total - 1) div chunk_size)")))
        .withColumn("take", F.greatest(F.lit(1), F.ceil(F.col("fraction") * in_chunk)).cast("bigint"))
        .select("ckpt", "chunk_size", "chunk", "k", "side", "take")
    )
    sizes, local = settle(plan.select("ckpt", "chunk_size", "mlp_total").distinct())
    placed = positioned(blocks, meta, block_size)
    elements = elements_of(placed).join(sizes, "ckpt").withColumns(
        {"key": magnitude_key(F.col("val")), "chunk": F.expr("gpos div chunk_size")}
    )
    return _pick(placed, cells, ["ckpt", "chunk_size", "chunk"], local if whole_blocks else None, elements)


def select_random(
    blocks: DataFrame, meta: DataFrame, ks: Sequence[float], seed: int = 0, block_size: int = BLOCK_SIZE
) -> DataFrame:
    """As many elements as the budget, whatever their values: the first in a seeded permutation of the positions.

    An element's rank is arithmetic on its position, so one pass over the blocks picks for all k, and nothing
    is counted, sorted or exploded.
    """
    plan = budgets(meta, ks).groupBy("ckpt", "mlp_total").agg(F.collect_list(F.struct("k", "budget")).alias("wanted"))
    return bk.random_picks(positioned(blocks, meta, block_size).join(plan, "ckpt"), seed)


def index_to_tensor(indices: DataFrame, meta: DataFrame, bucket_bits: int = 20) -> DataFrame:
    """Tensor and local position of external ``gpos`` lists.

    Both sides meet on a bucket of positions, so an index is compared with the few tensors of
    its bucket only; indices outside every tensor are left out.
    """
    spans = meta.filter("eligible and numel > 0").select("ckpt", "tensor", "offset", "numel")
    spans = spans.withColumn(
        "bucket",
        F.explode(
            F.sequence(
                F.shiftright("offset", bucket_bits), F.shiftright(F.col("offset") + F.col("numel") - 1, bucket_bits)
            )
        ),
    )
    keyed = indices.withColumn("bucket", F.shiftright("gpos", bucket_bits))
    hit = keyed.join(spans, ["ckpt", "bucket"]).filter(
        (F.col("gpos") >= F.col("offset")) & (F.col("gpos") < F.col("offset") + F.col("numel"))
    )
    return hit.select(*indices.columns, "tensor", (F.col("gpos") - F.col("offset")).alias("pos"))


def mask_blocks(selection: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Selected places per block, ``hits`` being 0-based offsets inside it (a block bounds it)."""
    return selection.groupBy(
        "ckpt", "k", "side", "tensor", F.expr(f"pos div {block_size}").alias("block")
    ).agg(F.sort_array(F.collect_list((F.col("pos") % block_size).cast("int"))).alias("hits"))


def layer_stats(meta: DataFrame, selection: DataFrame, ks: Sequence[float]) -> DataFrame:
    """Counts and percentages of selected elements per numbered tensor; tensors outside the
    numbered layers have no row, unselected ones have zeros."""
    counts = selection.groupBy("ckpt", "k", "tensor").agg(
        F.count_if(F.col("side") == "top").alias("top_n"),
        F.count_if(F.col("side") == "bottom").alias("bottom_n"),
    )
    done = budgets(meta, ks).select("ckpt", "k")
    layered = meta.filter(F.col("layer").isNotNull()).select("ckpt", "tensor", "layer", "eligible", "numel")
    rows = layered.join(done, "ckpt").join(counts, ["ckpt", "k", "tensor"], "left")

    def percent(n: str) -> Column:
        return numeric.two_decimals(F.col(n) / F.col("numel") * 100)

    zero = F.lit(0).cast("bigint")
    return (
        rows.withColumns({"top_n": F.coalesce("top_n", zero), "bottom_n": F.coalesce("bottom_n", zero)})
        .withColumns({"top_pct": percent("top_n"), "bottom_pct": percent("bottom_n")})
        .select(
            "ckpt", "k", "tensor", "layer", "eligible", "numel", "top_n", "top_pct", "bottom_n", "bottom_pct"
        )
        .orderBy("ckpt", "k", F.desc("eligible"), "layer", "tensor")
    )


def stats_text(stats: DataFrame) -> DataFrame:
    """Layer statistics in their written form."""
    def share(label: str, n: str, pct: str) -> Column:
        return F.format_string(f"{label}: %d (%.2f%%)", F.col(n), F.col(pct))

    # Headers and texts.
    return stats.select(
        "ckpt",
        format_k(F.col("k")).alias("k_label"),
        F.concat(F.lit("Layer: "), "tensor", F.lit(".pt")).alias("Layer"),
        F.concat(F.lit("Total Parameters: "), F.col("numel").cast("string")).alias("Total Parameters"),
        share("Top", "top_n", "top_pct").alias("Top"),
        share("Bottom", "bottom_n", "bottom_pct").alias("Bottom"),
    )


def eligible_cells(meta: DataFrame, ks: Sequence[float]) -> DataFrame:
    """(ckpt, k, tensor) of all eligible tensors, whether or not anything is selected there."""
    eligible = meta.filter("eligible").select("ckpt", "tensor")
    return eligible.join(budgets(meta, ks).select("ckpt", "k"), "ckpt").select("ckpt", "k", "tensor")


def selected_indices(
    selection: DataFrame, meta: DataFrame, ks: Sequence[float], block_size: int = BLOCK_SIZE
) -> DataFrame:
    """Top-selected positions per eligible tensor, ascending, in parts of one block of positions each;
    a tensor without any has one empty part."""
    parts = (
        selection.filter(F.col("side") == "top")
        .groupBy("ckpt", "tensor", F.col("k").alias("k_value"), F.expr(f"pos div {block_size}").alias("part"))
        .agg(F.sort_array(F.collect_list("pos")).alias("indices"))
        .select("ckpt", F.col("tensor").alias("layer_name"), "k_value", "part", "indices")
    )
    cells = eligible_cells(meta, ks).select("ckpt", F.col("tensor").alias("layer_name"), F.col("k").alias("k_value"))
    return cells.join(parts, ["ckpt", "layer_name", "k_value"], "left").withColumns({
        "part": F.coalesce("part", F.lit(0).cast("bigint")),
        "indices": F.coalesce("indices", F.array().cast("array<bigint>")),
    })


def selected_preview(selection: DataFrame, meta: DataFrame, ks: Sequence[float], n: int = 10) -> DataFrame:
    """Count and first ``n`` top positions per eligible tensor, in the order of selection: chunk by chunk,
    largest magnitude first. Only ``n`` rows per tensor and task reach the shuffle."""
    top = selection.filter(F.col("side") == "top")
    keys = ["ckpt", "k", "tensor"]
    order = Window.partitionBy(*keys).orderBy("chunk", F.abs("val").desc(), "gpos")
    first = (
        top.withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= n)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "pos"))), lambda x: x["pos"]).alias("head"))
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("head", lambda p: p.cast("string")), ", "), F.lit("]"))
    found = (
        top.groupBy(*keys)
        .agg(F.count("*").alias("index_count"))
        .join(first, keys)
        .withColumn("preview", F.when(F.col("index_count") > n, F.concat(text, F.lit("..."))).otherwise(text))
        .drop("head")
    )
    return eligible_cells(meta, ks).join(found, keys, "left").withColumns({
        "index_count": F.coalesce("index_count", F.lit(0).cast("bigint")), "preview": F.coalesce("preview", F.lit("[]")),
    })

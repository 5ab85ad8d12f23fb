"""Applying masks to weight tables.

Weights are block rows (tensor, shape, block, weight). Masks stay sparse: per block the places
to zero. Weights are shuffled at most once however many variants are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrays as ar
from ..functions.naming import file_safe
from ..session import stage
from .masks import UNUSABLE, compressed, shape_status, zeroed
from .region import BLOCK_SIZE, mask_blocks

VARIANT = ["ckpt", "k", "side"]
#: Variants a weight row fans out to at once.
VARIANT_GROUP = 1024


def missing_masks(weights: DataFrame, masks: DataFrame) -> DataFrame:
    """Tensors for which no mask goes by their file-safe name."""
    names = masks.select(file_safe(F.col("tensor")).alias("name")).distinct()
    tensors = weights.select("tensor").distinct()
    return tensors.withColumn("name", file_safe(F.col("tensor"))).join(names, "name", "left_anti")


def shape_report(params: DataFrame, masks: DataFrame) -> DataFrame:
    """How a mask's shape relates to its parameter's, both tables being (tensor, shape): see ``masks.shape_status``."""
    pairs = (
        params.select(file_safe(F.col("tensor")).alias("name"), "tensor", F.col("shape").alias("shape"))
        .join(masks.select(file_safe(F.col("tensor")).alias("name"), F.col("shape").alias("mask_shape")), "name")
    )
    return pairs.select("tensor", "shape", "mask_shape", shape_status(F.col("shape"), F.col("mask_shape")).alias("status"))


def repair(selection: DataFrame, report: DataFrame) -> DataFrame:
    """Selected places that exist in the parameter; an unusable mask is an error.

    Row-major positions make padding a no-op and cutting a filter.
    """
    bad = report.filter(F.col("status").isin(*UNUSABLE)).select("tensor", "status").head(1)
    if bad:
        raise ValueError(f"mask of {bad[0]['tensor']} does not match its parameter: {bad[0]['status']}")
    numel = F.aggregate("shape", F.lit(1).cast("bigint"), lambda n, d: n * d)
    sizes = report.select("tensor", numel.alias("numel"))
    return selection.join(sizes, "tensor").filter("pos < numel").drop("numel")


def mask_containers(selection: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Selected places as compressed masks: (ckpt, k, side, tensor, block, kind, n, data)."""
    return compressed(mask_blocks(selection, block_size))


def _named(weights: DataFrame, mask_shapes: DataFrame | None) -> DataFrame:
    """Weights with the file-safe name; a mask that can't be used raises an error when its parameter is read.

    ``mask_shapes`` gives (tensor, shape) of every mask, also of those without a place. Without it masks are
    taken to have their parameters' shapes.
    """
    named = weights.withColumn("__name", file_safe(F.col("tensor")))
    if mask_shapes is None:
        return named
    shapes = mask_shapes.select(file_safe(F.col("tensor")).alias("__name"), F.col("shape").alias("__mask_shape")).distinct()
    status = shape_status(F.col("shape"), F.col("__mask_shape"))
    message = F.concat(F.lit("mask of "), F.col("tensor"), F.lit(" does not match its parameter: "), status)
    checked = F.when(status.isin(*UNUSABLE), F.raise_error(message)).otherwise(F.col("__name"))
    # Kept as a value that is needed, so that the check is made whatever is read of the result.
    return named.join(shapes, "__name", "left").withColumn("__name", checked).filter(F.col("__name").isNotNull()).drop("__mask_shape")


def apply_mask(
    weights: DataFrame, masks: DataFrame, block_size: int = BLOCK_SIZE, mask_shapes: DataFrame | None = None
) -> DataFrame:
    """Zero the masked places; ``masks`` is one variant's selection (ckpt, k, side, tensor, pos) or its containers.

    Masks with fewer or more first rows than their parameter are padded or cut; other differences of shape
    raise an error (``mask_shapes``).
    """
    packed = masks if "data" in masks.columns else mask_containers(masks, block_size)
    held = packed.select(file_safe(F.col("tensor")).alias("__name"), "block", "kind", "data")
    joined = _named(weights, mask_shapes).join(held, ["__name", "block"], "left").drop("__name")
    return zeroed(joined.select(*weights.columns, "kind", "data"))


def dense_masks(blocks: DataFrame, selection: DataFrame, variants: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Boolean mask blocks for every numbered tensor and variant; all False where nothing is selected.

    ``blocks`` gives (ckpt, tensor, shape, block); block sizes come from the shape, values are not read.
    """
    numel = F.aggregate("shape", F.lit(1).cast("bigint"), lambda n, d: n * d)
    cells = variants.groupBy("ckpt").agg(F.collect_list(F.struct("k", "side")).alias("cells"))
    grid = (
        blocks.select("ckpt", "tensor", "block", numel.alias("numel"))
        .join(cells, "ckpt")
        .withColumn("cell", F.explode("cells"))
        .select("ckpt", "cell.k", "cell.side", "tensor", "block", "numel")
    )
    size = F.least(F.lit(block_size), F.col("numel") - F.col("block") * block_size).cast("int")
    hits = mask_blocks(selection, block_size)
    return grid.join(hits, [*VARIANT, "tensor", "block"], "left").select(
        *VARIANT, "tensor", "block", ar.dense_mask(F.col("hits"), size).alias("mask")
    )


def paired_variants(selection: DataFrame) -> DataFrame:
    """(ckpt, k, side) for checkpoints that have both a top and a bottom mask."""
    have = selection.groupBy("ckpt", "k").agg(
        F.count_if(F.col("side") == "top").alias("t"), F.count_if(F.col("side") == "bottom").alias("b")
    )
    return have.filter("t > 0 and b > 0").select("ckpt", "k", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("side"))


def damage_variants(
    weights: DataFrame, masks: DataFrame, block_size: int = BLOCK_SIZE, mask_shapes: DataFrame | None = None
) -> DataFrame:
    """Full weight tables for every checkpoint, k and side with masks; ``masks`` and ``mask_shapes`` as in ``apply_mask``.

    Variants are numbered and dealt into groups of ``VARIANT_GROUP``. Weights meet the masks of each
    group in one join on (name, block, group) and fan out afterwards, so that no row holds more than
    a group's variants, however many there are.
    """
    numbered = paired_variants(masks).withColumn("n", F.row_number().over(Window.orderBy(*VARIANT)) - 1)
    numbered = numbered.withColumns({"g": F.expr(f"n div {VARIANT_GROUP}").cast("int"), "n": (F.col("n") % VARIANT_GROUP).cast("int")})
    groups = stage(
        numbered.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("n", *VARIANT))).alias("variants")), "variants"
    )
    n_groups = groups.count()
    if not n_groups:
        return weights.limit(0).selectExpr("'' AS ckpt", "0.0D AS k", "'' AS side", "*")
    flat = groups.select("g", F.explode("variants").alias("v")).select("g", "v.*")
    per_block = (
        (masks if "data" in masks.columns else mask_containers(masks, block_size))
        .join(flat, VARIANT)
        .groupBy(file_safe(F.col("tensor")).alias("__name"), "block", "g")
        .agg(F.collect_list(F.struct(flat["n"], "kind", "data")).alias("masks"))
    )
    named = _named(weights, mask_shapes).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    joined = named.join(per_block, ["__name", "block", "g"], "left").join(groups, "g")
    held = F.coalesce("masks", F.array().cast("array<struct<n:int,kind:string,data:binary>>"))
    # Each variant once: those with a mask here with it, the others with none.
    others = F.array_except(F.transform("variants", lambda v: v["n"]), F.transform(held, lambda m: m["n"]))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("data", "binary"))]
    every = F.concat(held, F.transform(others, lambda n: F.struct(n.alias("n"), *nothing)))
    fanned = joined.withColumn("m", F.explode(every)).withColumn("v", F.get("variants", F.col("m.n")))
    return zeroed(fanned.select("v.ckpt", "v.k", "v.side", *weights.columns, "m.kind", "m.data"))

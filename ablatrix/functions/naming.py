"""Column kernels on tensor and checkpoint names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: where the layer number stands in a tensor name.
LAYER_PATTERN = r"model\.layers\.(\d+)\."


def layer_of(tensor: Column) -> Column:
    """Layer number, or null for tensors outside the numbered layers."""
    return F.nullif(F.regexp_extract(tensor, LAYER_PATTERN, 1), F.lit("")).cast("int")


def is_mlp(tensor: Column) -> Column:
    return F.lower(tensor).contains("mlp")


def file_safe(tensor: Column) -> Column:
    return F.replace(F.replace(tensor, F.lit(".pt"), F.lit("")), F.lit("."), F.lit("_"))


def strip_module(tensor: Column) -> Column:
    return F.replace(tensor, F.lit("module."), F.lit(""))


def is_damaged_checkpoint(ckpt: Column) -> Column:
    return ckpt.contains("damage")

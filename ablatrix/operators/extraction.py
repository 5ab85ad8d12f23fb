"""Turning a record into one text, and dropping texts without content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx


def _as_text(df: DataFrame, key: str) -> Column:
    value = F.col(key)
    if df.schema[key].dataType.typeName() == "array":
        value = F.array_join(value, " ")
    missing = F.raise_error(F.lit(f"key not found: {key}")).cast("string")
    return F.when(value.isNotNull(), value).otherwise(missing)


def extract_text(df: DataFrame, keys: str | Sequence[str], into: str = "text") -> DataFrame:
    """Join the values of one or several keys by a space; list values are joined first.

    A row that lacks a key is an error, as is a key that is no column.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    absent = [k for k in keys if k not in df.columns]
    if absent:
        raise ValueError(f"keys not found: {', '.join(absent)}")
    return df.withColumn(into, F.concat_ws(" ", *[_as_text(df, k) for k in keys]))


def drop_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(~tx.is_blank(F.col(column)))

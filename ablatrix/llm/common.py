"""Small helpers the operators share."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white-space characters; a run of them separates words. In a pattern, single
#: characters are matched faster than ranges.
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def key_share(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def words_of(text: str | Column) -> Column:
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def shipped(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object together with its classes, so that executors need no copy of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(box: Broadcast) -> Any:
    """What ``shipped`` sent; to be called once per task."""
    return pickle.loads(box.value)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a task makes of one at a time stays small."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)

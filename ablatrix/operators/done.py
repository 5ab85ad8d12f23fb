"""Which rows an earlier run has done: a Bloom filter beside the output, asked before the exact join.

The filter is a table of bitmaps of 32,768 bits. A key's hash names one bitmap and a few bits in it, so building
and merging are grouped bitmap aggregates, partial ones first, and asking is an equi-join on the bitmap's number
and a look at the bits. Rows it doesn't know are new for sure; only the others meet the done keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import null_safe_join, stage

#: Bits of a bitmap (Spark's own bitmaps have this size), bits for a key, and bits of the filter a key should have.
BITMAP_BITS = 1 << 15
HASHES = 6
BITS_PER_KEY = 12


def _hash(keys: list[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys], *[F.col(f"`{k}`").isNull() for k in keys])


def _bits(keys: list[str]) -> Column:
    """Places in the bitmap: six stretches of 15 bits out of two hashes."""
    words = [_hash(keys, 1), _hash(keys, 2)]
    return F.array(*[F.shiftrightunsigned(words[i // 3], 15 * (i % 3)).bitwiseAND(BITMAP_BITS - 1) for i in range(HASHES)])


def _bitmap(keys: list[str], size: Column) -> Column:
    return F.pmod(_hash(keys, 0), size)


def build_filter(done: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """``size`` (number of bitmaps, a power of two), ``bitmap`` and ``bits`` for the keys in ``done``.

    ``expected`` keys decide the size; without it the rows are counted.
    """
    n = done.count() if expected is None else expected
    size = 1 << max(0, (-(-max(1, n) * BITS_PER_KEY // BITMAP_BITS) - 1).bit_length())
    placed = done.select(_bitmap(keys, F.lit(size)).alias("bitmap"), F.explode(_bits(keys)).alias("bit"))
    return placed.groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits")).select(F.lit(size).cast("bigint").alias("size"), "bitmap", "bits")


def merge_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the keys of both; the larger one is folded to the size of the smaller."""
    both = one.unionByName(other)
    size = both.agg(F.min("size")).first()[0] or 1
    folded = both.groupBy(F.pmod("bitmap", F.lit(size)).alias("bitmap")).agg(F.bitmap_or_agg("bits").alias("bits"))
    return folded.select(F.lit(size).cast("bigint").alias("size"), "bitmap", "bits")


def write_filter(bloom: DataFrame, path: str, mode: str = "errorifexists") -> None:
    bloom.write.mode(mode).parquet(path)


def read_filter(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_probe(df: DataFrame, bloom: DataFrame, keys: list[str], into: str = "maybe_done") -> DataFrame:
    """Add whether the filter may hold the row's key; false is certain."""
    size = bloom.agg(F.max("size")).first()[0] or 1
    held = bloom.select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits"))

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), 1)), 16, 10).cast("int")
        return F.call_function("getbit", byte, (bit % 8).cast("int")) == 1

    probed = df.withColumn("__bitmap", _bitmap(keys, F.lit(size))).join(held, "__bitmap", "left")
    hit = F.col("__bits").isNotNull() & F.forall(_bits(keys), is_set)
    return probed.withColumn(into, F.coalesce(hit, F.lit(False))).select(*df.columns, into)


def not_done(df: DataFrame, done: DataFrame, keys: list[str], bloom: DataFrame | None = None) -> DataFrame:
    """Rows whose keys an earlier run has not processed; a null key is a key like any other.

    With ``bloom``, rows it doesn't know pass at once, and the done keys are read only if some rows are left,
    and joined to those alone. The result is the same.
    """
    if bloom is None:
        return null_safe_join(df, done.select(*keys).distinct(), keys, "left_anti")
    probed = stage(with_probe(df, bloom, keys, "__maybe"), "probed")
    known = probed.filter("__maybe").drop("__maybe")
    new = probed.filter("not __maybe").drop("__maybe")
    if known.isEmpty():
        return new
    asked = null_safe_join(done.select(*keys), known.select(*keys).distinct(), keys, "left_semi")
    return new.unionByName(null_safe_join(known, asked.distinct(), keys, "left_anti"))

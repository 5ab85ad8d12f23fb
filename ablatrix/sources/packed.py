"""Packed sample tables: samples in order of id, a manifest of samples per type, and a sparse index of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.arrays import truncate
from ..operators.packing import integrity_violations, manifest

PACKED = ["sample_id", "type", "start", "length", "tokens"]
#: Samples a file should hold, and at least, when there are few for the slots there are.
FILE_SAMPLES, LEAST_SAMPLES = 1 << 16, 256
INDEX = ["lo", "hi", "n_samples", "begin", "end"]


def write_packed(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples in id order, their manifest, and an index: per file its range of ids and of tokens.

    Ids are dense, so a sample's file is arithmetic; no sampling pass is needed to find ranges.
    """
    out = samples if "type" in samples.columns else samples.withColumn("type", F.lit(0))
    out = out.select(
        F.col("sample_id").cast("bigint"), F.col("type").cast("int"), F.col("start").cast("bigint"),
        F.col("length").cast("int"), F.col("tokens").cast("array<int>"),
    )
    spark = out.sparkSession
    n = (out.agg(F.max("sample_id")).first()[0] or 0) + 1
    files = max(-(-n // FILE_SAMPLES), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_SAMPLES)))
    at = F.floor(F.col("sample_id") * files / n).cast("int")
    out.repartitionById(files, at).sortWithinPartitions("sample_id").write.mode(mode).parquet(f"{path}/samples")
    written = read_packed(spark, path)
    manifest(written).write.mode(mode).parquet(f"{path}/manifest")
    file_ranges(written).coalesce(1).write.mode(mode).parquet(f"{path}/index")


def file_ranges(samples: DataFrame) -> DataFrame:
    """One row per file of a stored packed table."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    return samples.groupBy(name).agg(
        F.min("sample_id").alias("lo"), F.max("sample_id").alias("hi"), F.count("*").alias("n_samples"),
        F.min("start").alias("begin"), F.max(F.col("start") + F.col("length")).alias("end"),
    )


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/samples")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def check_index(spark: SparkSession, path: str) -> DataFrame:
    """What the index alone shows to be wrong, reading no sample: files that don't follow each other, and
    a manifest that counts other samples. No rows when it is sound."""
    files = F.array_sort(F.collect_list(F.struct("lo", "hi", "n_samples", "begin", "end")))
    listed = read_index(spark, path).agg(files.alias("f"), F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n"))
    after = F.filter(F.zip_with("f", F.slice("f", 2, F.greatest(F.size("f"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull())
    apart = F.exists(after, lambda p: (p["b"]["lo"] != p["a"]["hi"] + 1) | (p["b"]["begin"] != p["a"]["end"]))
    holes = F.exists("f", lambda x: x["hi"] - x["lo"] + 1 != x["n_samples"])
    first = F.try_element_at("f", F.lit(1))
    wrong = F.coalesce(apart | holes | (first["lo"] != 0) | (first["begin"] != 0), F.lit(False))
    counted = read_manifest(spark, path).agg(F.coalesce(F.sum("n_samples"), F.lit(0)).alias("m"))
    return listed.crossJoin(counted).select(F.explode(F.array_compact(F.array(
        F.when(wrong, F.lit("index")), F.when(F.col("n") != F.col("m"), F.lit("manifest"))
    ))).alias("problem"))


def check_packed(spark: SparkSession, path: str) -> DataFrame:
    """What is wrong with a packed table; no rows when it is sound.

    ``gap``: the sample's end is not its successor's start; ``length``: it holds another number of tokens than
    stated; without a sample, ``totals`` that don't add up, ``manifest``: a type has other samples than
    counted, and ``index``: a file is not as the index says.
    """
    samples = read_packed(spark, path)
    expected = read_manifest(spark, path).agg(F.sum("n_samples")).first()[0] or 0
    lengths = samples.filter(~F.col("length").eqNullSafe(F.size("tokens"))).select("sample_id", F.lit("length").alias("problem"))
    none = F.lit(None).cast("bigint").alias("sample_id")
    types = manifest(samples).join(read_manifest(spark, path).withColumnRenamed("n_samples", "stated"), "type", "full")
    miscounted = types.filter(~F.col("n_samples").eqNullSafe(F.col("stated"))).select(none, F.lit("manifest").alias("problem"))
    stated = read_index(spark, path).withColumnsRenamed({c: f"{c}_stated" for c in INDEX})
    files = file_ranges(samples).join(stated, "file", "full")
    same = F.lit(True)
    for c in INDEX:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_stated"))
    moved = files.agg(F.count_if(~same).alias("n")).filter("n > 0").select(none, F.lit("index").alias("problem"))
    return integrity_violations(samples, n_samples=expected).unionByName(lengths).unionByName(miscounted).unionByName(moved)


def samples_at(spark: SparkSession, path: str, ids: Sequence[int], length: int | None = None) -> DataFrame:
    """Samples by id, their tokens cut to ``length``; ids that the table lacks give no row.

    The index names the files that can hold them; no other file is read, and within those the row groups'
    ranges of ids are skipped by the filter.
    """
    wanted = sorted(set(ids))
    if not wanted:
        return read_packed(spark, path).limit(0)
    asked = F.array(*[F.lit(i).cast("bigint") for i in wanted])
    holds = F.exists(asked, lambda i: i.between(F.col("lo"), F.col("hi")))
    files = [r["file"] for r in read_index(spark, path).filter(holds).select("file").orderBy("lo").collect()]  # one for each id at most
    if not files:
        return read_packed(spark, path).limit(0)
    found = spark.read.parquet(*[f"{path}/samples/{f}" for f in files]).filter(F.col("sample_id").isin(wanted))
    return found if length is None else found.withColumn("tokens", truncate(F.col("tokens"), length))


def sample(samples: DataFrame, sample_id: int | Column, length: int) -> DataFrame:
    """One sample by id, its tokens cut to ``length``."""
    return samples.filter(F.col("sample_id") == sample_id).withColumn(
        "tokens", truncate(F.col("tokens"), length)
    )

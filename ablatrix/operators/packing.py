"""Packed sample tables: dense sample ids, token offsets, integrity, merging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import arrays as ar
from ..session import null_safe_join, settle, stage
from .running import id_levels, running_sums

#: Documents whose places the planner may broadcast; the tokens that a partition has when there are more.
PLACED_ROWS, PARTITION_TOKENS = 1 << 20, 1 << 23


def number_segments(df: DataFrame, key: str = "doc_id", by: Sequence[str] = ()) -> DataFrame:
    """Number samples and give each its first token's position, in (key, draw) order: one row per sample.

    Expects documents with ``drawn`` segments. The documents are written with their segments' lengths summed
    inside each one; only (key, counts) rows, one per document, are summed up in parallel, and what lies
    before a document comes back to it. Segments and tokens are in no window. With ``by``, numbering starts
    anew per group, however large a group is; documents of equal keys follow each other.
    """
    lengths = F.transform("drawn", lambda x: F.size(x["tokens"]))
    rows = stage(
        df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__lengths", lengths)
        .withColumn("__before", ar.prefix_sums("__lengths")),
        "drawn",
    )
    total = F.aggregate("__lengths", F.lit(0).cast("bigint"), lambda a, n: a + n)
    documents = rows.select("__row", key, *by, F.size("__lengths").alias("__n"), total.alias("__t"))
    sums = running_sums(documents, [key, "__row"], id_levels(key), {"__id": F.col("__n"), "__start": F.col("__t")}, by=by)
    places = stage(sums.select("__row", "__id", "__start"), "places")
    kept = [c for c in df.columns if c != "drawn"]
    # Many documents meet their places in so many partitions that none has to be sorted on disk.
    if places.count() > PLACED_ROWS:
        parts = -(-documents.agg(F.sum("__t")).first()[0] // PARTITION_TOKENS)
        rows, places = (t.repartition(max(df.sparkSession.sparkContext.defaultParallelism, parts), "__row") for t in (rows, places))
    # Told apart by place rather than exploded with their tokens, so that counting reads no tokens.
    numbered = rows.join(places, "__row").select("*", F.posexplode("__before").alias("draw", "__at"))
    segment = F.get("drawn", F.col("draw"))
    return numbered.select(
        *kept, "draw", segment["seg"].alias("seg"), F.get("__lengths", F.col("draw")).alias("length"), segment["tokens"].alias("tokens"),
        (F.col("__id") + F.col("draw")).alias("sample_id"), (F.col("__start") + F.col("__at")).alias("start"),
    )


def manifest(samples: DataFrame) -> DataFrame:
    """Samples per type."""
    return samples.groupBy("type").agg(F.count("*").alias("n_samples"))


def integrity_violations(samples: DataFrame, total_tokens: int | None = None, n_samples: int | None = None) -> DataFrame:
    """Samples whose end is not their successor's start, and totals that do not add up.

    A block's first sample is also sent to the block before it, so each block checks its own
    seam; only (id, start, length) is shuffled, once.
    """
    blocks = F.array_distinct(
        F.array(F.shiftright("sample_id", 16), F.shiftright(F.col("sample_id") - 1, 16))
    )
    cells = samples.select("sample_id", "start", "length").select("*", F.explode(blocks).alias("b"))
    w = Window.partitionBy("b").orderBy("sample_id")
    seams = (
        cells.withColumns({"next_id": F.lead("sample_id").over(w), "next_start": F.lead("start").over(w)})
        .filter(
            (F.col("next_start") != F.col("start") + F.col("length"))
            | (F.col("next_id") != F.col("sample_id") + 1)
        )
        .select("sample_id", F.lit("gap").alias("problem"))
    )
    totals = samples.agg(
        F.count("*").alias("n"),
        F.sum("length").alias("tokens"),
        F.min("sample_id").alias("lo"),
        F.max("sample_id").alias("hi"),
        F.max(F.col("start") + F.col("length")).alias("end"),
        F.min("start").alias("begin"),
    )
    wrong = [
        (F.col("n") > 0) & ((F.col("lo") != 0) | (F.col("begin") != 0)),
        (F.col("n") > 0) & ((F.col("hi") != F.col("n") - 1) | (F.col("end") != F.col("tokens"))),
    ]
    if total_tokens is not None:
        wrong.append(F.coalesce("tokens", F.lit(0)) != total_tokens)
    if n_samples is not None:
        wrong.append(F.col("n") != n_samples)
    bad = reduce(lambda a, b: a | b, wrong)
    return seams.unionByName(
        totals.filter(bad).select(F.lit(None).cast("bigint").alias("sample_id"), F.lit("totals").alias("problem"))
    )


def merge_packed(samples: DataFrame, source: str, source_type: str | None = None) -> DataFrame:
    """Concatenate packed datasets held in one table, ``source`` being each one's ordinal.

    Ids and starts are shifted by what precedes the source: sources in order of ordinal, or with
    ``source_type`` grouped by type, types in the order they first appear. Only per-source totals
    are shuffled; the samples take their shift from a table of one row per source.
    """
    per_source = samples.groupBy(source, *([source_type] if source_type else [])).agg(
        F.count("*").alias("__n"), F.sum(F.col("length").cast("bigint")).alias("__t")
    )
    sums = {"__ids": F.col("__n"), "__starts": F.col("__t")}
    if source_type is None:
        shifts = running_sums(per_source, [source], id_levels(source), sums)
        order: list[str] = []
    else:
        inside = running_sums(per_source, [source], id_levels(source), sums, by=[source_type])
        per_type = per_source.groupBy(source_type).agg(
            F.min(source).alias("__first"), F.sum("__n").alias("__n"), F.sum("__t").alias("__t")
        )
        ahead = running_sums(per_type, ["__first"], id_levels("__first"), sums).select(
            source_type, F.col("__ids").alias("__tids"), F.col("__starts").alias("__tstarts")
        )
        shifts = null_safe_join(inside, ahead, [source_type]).withColumns(
            {"__ids": F.col("__ids") + F.col("__tids"), "__starts": F.col("__starts") + F.col("__tstarts")}
        )
        order = [source_type]
    keys = [source, *order]
    shifts, _ = settle(shifts.select(*keys, "__ids", "__starts"))
    return (
        null_safe_join(samples, shifts, keys)
        .withColumns(
            {"sample_id": F.col("sample_id") + F.col("__ids"), "start": F.col("start") + F.col("__starts")}
        )
        .drop("__ids", "__starts")
    )


def merge_datasets(parts: Sequence[DataFrame], types: Sequence[int] | None = None) -> DataFrame:
    """Concatenate packed datasets given as a list, optionally with a type for each."""
    if types is not None and len(types) != len(parts):
        raise ValueError("one type per dataset is needed")
    tagged = [
        p.withColumns({"source": F.lit(i), "type": F.lit(0 if types is None else types[i])})
        for i, p in enumerate(parts)
    ]
    together = reduce(lambda a, b: a.unionByName(b), tagged)
    return merge_packed(together, "source", None if types is None else "type")


def head_samples(samples: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` samples of a packed table (ids are dense, so this is a pushed-down filter)."""
    return samples.filter(F.col("sample_id") < n)


def cap_samples(samples: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` samples at most; None keeps all."""
    return samples if cap is None else samples.filter(F.col("sample_id") < cap)

"""Inputs derived from the sample tables, and tables staged once per session.

Staged tables are written to the shared folder and read back, so the many queries on top of
them do not tokenise or lay out the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import naming, text as tx
from ..functions.hashing import order_hash
from ..operators import corpus, packing
from ..operators.attribution import grad_times_weight
from ..operators.running import hash_levels, id_levels, running_sums
from ..operators.tokens import word_tokens
from ..session import scratch_path, spread, stage
from ..sources import packed

SEGMENT_LENGTH = 512
VECTOR_LENGTH = 64
VOCAB_SEED = 7
FIRST_WORD_ID = 3
# The selection fractions in use.
K_VALUES = [0.00001, 0.00004, 0.00016, 0.00064, 0.00256, 0.01024]

_staged: dict[tuple[str, str, str], tuple[SparkSession, DataFrame | str]] = {}


def once(name: str) -> Callable:
    """Build a table, or write it and keep its path, once per session and input folder."""

    def wrap(build: Callable[[SparkSession, str], DataFrame | str]) -> Callable[[SparkSession, str], DataFrame | str]:
        def get(spark: SparkSession, sf_dir: str) -> DataFrame | str:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _staged or _staged[key][0] is not spark:
                _staged[key] = spark, build(spark, sf_dir)
            return _staged[key][1]

        get.__doc__ = build.__doc__
        return get

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


# Question types.
QA_TYPES = [
    "single_fact_recall", "multi_hop_recall", "world_fact", "roles_and_relations", "logic_puzzle",
    "pattern_completion", "analogy", "arithmetic_word_problem", "temporal_order", "spatial_relation",
    "everyday_cause_effect", "unmapped_type",
]
CONTEXT_TAIL = " It rained because of wind. All boxes left of Bob moved before noon. Add 3.5 plus 2."
# Ids of the rows without context are those of their documents and this.
WITHOUT_CONTEXT = 1_000_000_000
QUESTION_TAIL = " Was it first or in front of 7 at 2 pm?"


def qa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as QA rows of all question types, one of them without a rewrite of its own."""
    types = F.array(*[F.lit(t) for t in QA_TYPES])
    docs = documents(spark, sf_dir)
    context = F.concat("text", F.lit(CONTEXT_TAIL))
    # Some questions come once more without a context.
    both = docs.select("*", context.alias("context"), F.col("doc_id").alias("item_id")).union(
        docs.filter(F.col("doc_id") % 7 == 0).select("*", F.lit(""), F.col("doc_id") + WITHOUT_CONTEXT)
    )
    return both.select(
        "item_id",
        F.element_at(types, (F.col("doc_id") % len(QA_TYPES) + 1).cast("int")).alias("question_type"),
        "context",
        F.concat("text", F.lit(QUESTION_TAIL)).alias("question"),
        F.split("text", " ").alias("options"),
        F.col("lang").alias("answer"),
    )


@once("vocab")
def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of the documents with a dense id from ``FIRST_WORD_ID`` on."""
    words = (
        documents(spark, sf_dir)
        .select(F.explode(word_tokens(F.col("text"))).alias("token"))
        .distinct()
        .withColumn("h", order_hash(VOCAB_SEED, F.col("token")))
    )
    # The running sums read the words twice; texts are cut into them once.
    ranked = running_sums(stage(words, "words"), ["h", "token"], hash_levels("h"), {"rank": F.lit(1)})
    ids = ranked.select("token", (F.col("rank") + FIRST_WORD_ID).cast("int").alias("id"))
    return stage(ids, "vocab")


@once("encoded")
def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sentences of ids: (doc_id, source, ids)."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return stage(corpus.token_sentences(docs, vocab(spark, sf_dir)), "encoded")


def drawn(spark: SparkSession, sf_dir: str, mode: str = "greedy", length: int = SEGMENT_LENGTH) -> DataFrame:
    """Documents with all their segments: (doc_id, source, drawn)."""
    return corpus.draw_segments(corpus.segments_of(encoded(spark, sf_dir), length, mode), -1)


@once("packed_path")
def packed_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the packed samples of all documents are written."""
    path = scratch_path(spark, "packed")
    packed.write_packed(packing.number_segments(drawn(spark, sf_dir)), path)
    return path


def packed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed samples of all documents, read back."""
    return packed.read_packed(spark, packed_path(spark, sf_dir))


@once("packed_by_source")
def packed_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packed dataset per document source in one table: (source, ordinal, kind, ...)."""
    per_source = packing.number_segments(drawn(spark, sf_dir), by=["source"])
    ordinal = F.substring("source", 4, 10).cast("int")
    return stage(
        per_source.select(
            "source", ordinal.alias("ordinal"), ((ordinal * 7) % 3).cast("int").alias("kind"),
            "sample_id", "start", "length", "tokens",
        ),
        "by-source",
    )


def tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as rows of named tensors: eligible, ineligible and outside the layers."""
    def named(part: str):
        return F.concat(F.lit("model.layers."), F.col("label").cast("string"), F.lit(part))

    tensor = (
        F.when(F.col("vec_id") % 17 == 0, F.lit("model.embed_tokens.weight"))
        .when(F.col("vec_id") % 3 == 0, named(".mlp.gate_proj.weight"))
        .when(F.col("vec_id") % 3 == 1, named(".self_attn.q_proj.weight"))
        .otherwise(named(".mlp.down_proj.weight"))
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", tensor.alias("tensor"), F.col("embedding").alias("vals"))


@once("blocks")
def tensor_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensor rows in block form: (ckpt, tensor, shape, block, vec_id, vals), one vector per block."""
    rows = running_sums(
        tensor_rows(spark, sf_dir), ["vec_id"], id_levels("vec_id"), {"block": F.lit(1)}, by=["tensor"]
    )
    heights = tensor_rows(spark, sf_dir).groupBy("tensor").agg(F.count("*").cast("int").alias("height"))
    blocks = rows.join(heights, "tensor").select(
        F.lit("checkpoint_full").alias("ckpt"), "tensor",
        F.array("height", F.lit(VECTOR_LENGTH)).alias("shape"), "block", "vec_id", "vals",
    )
    return stage(blocks, "blocks")


def checkpoint_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four checkpoints: all tensors; five layers; no MLP tensor; one MLP tensor beside all the others."""
    blocks, layer = tensor_blocks(spark, sf_dir), naming.layer_of(F.col("tensor"))
    mlp = naming.is_mlp(F.col("tensor"))
    parts = {
        "checkpoint_full": F.lit(True), "checkpoint_low": F.coalesce(layer < 5, F.lit(True)), "checkpoint_attention": ~mlp,
        "checkpoint_small": ~mlp | (F.col("tensor") == "model.layers.0.mlp.down_proj.weight"),
    }
    held = [blocks.filter(hit).withColumn("ckpt", F.lit(name)) for name, hit in parts.items()]
    return reduce(DataFrame.unionByName, held)


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in gradients: each vector's gradient is the next vector."""
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    following = vectors.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("grad"))
    return (
        tensor_blocks(spark, sf_dir)
        .withColumn("next_id", (F.col("vec_id") + 1) % n)
        .join(following, "next_id")
        .select("ckpt", "tensor", "shape", "block", "grad")
    )


def micro_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients of several batches on the same four blocks of each tensor."""
    return gradients(spark, sf_dir).select(
        "tensor", (F.col("block") % 4).alias("block"), F.expr("block div 4").alias("batch"), "grad"
    )


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_blocks(spark, sf_dir).select("tensor", "shape", "block", F.col("vals").alias("weight"))


@once("attribution")
def attribution_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient times weight, rounded: (ckpt, tensor, shape, block, vals)."""
    grads = gradients(spark, sf_dir).drop("shape")
    return stage(
        grad_times_weight(grads, weights(spark, sf_dir)).select("ckpt", "tensor", "shape", "block", "vals"),
        "attribution",
    )


RESULT_CELLS = [
    ("original", "original", 0.0),
    ("checkpoint_full", "top", 0.00256),
    ("checkpoint_full", "bottom", 0.00256),
    ("checkpoint_full", "top", 0.01024),
    ("checkpoint_full", "bottom", 0.01024),
]
BENCHMARKS = [f"b{i}" for i in range(10)]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in scores per item; one benchmark lacks its bottom runs."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("ckpt"), F.lit(s).alias("side"), F.lit(k).alias("k")) for c, s, k in RESULT_CELLS]
    )
    correct = F.when(F.col("c.side") == "original", F.col("quality")).otherwise(F.col("quality") * (1 - F.col("toxic")))
    rows = table(spark, sf_dir, "labels").withColumn("c", F.explode(cells)).select(
        F.concat(F.lit("d"), (F.expr("doc_id div 10") % 2).cast("string")).alias("dataset"),
        "c.ckpt", "c.side", "c.k",
        F.concat(F.lit("b"), (F.col("doc_id") % 10).cast("string")).alias("benchmark"),
        F.lit(0).alias("num_fewshot"),
        F.col("doc_id").alias("item_id"),
        correct.cast("int").alias("correct"),
    )
    return rows.filter(~((F.col("benchmark") == "b3") & (F.col("side") == "bottom")))

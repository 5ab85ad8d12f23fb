"""The processing chains end to end, each stage a table of the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chat
from ..operators import corpus, corruption, damage, packing, region
from ..operators.attribution import grad_times_weight
from ..session import stage
from ..sources import jsonl, packed, tensors


def corrupt_abilities(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Rewrite every ability's JSONL splits; returns row counts per ability and split."""
    rows = jsonl.read_abilities(spark, root)
    jsonl.write_qa(corruption.corrupt_corpus(rows), target)
    return corruption.rewrite_counts(jsonl.read_splits(spark, target), "ability", "split")


def prepare_corpus(
    qa: DataFrame, vocab: DataFrame, target: str, length: int = 512, per_doc: int = -1,
    template: chat.ChatTemplate = chat.TEMPLATES["header"], mode: str = "drop", key: str = "item_id",
) -> DataFrame:
    """QA rows to a packed table at ``target``; returns its integrity problems (none expected).

    Drawn segments are written before they are numbered, so numbering reads lengths from storage and
    texts are tokenised once.
    """
    rendered = corpus.chat_rows(qa, template)
    texts = rendered.select(key, chat.strip_system(F.col("content")).alias("text"))
    ids = corpus.token_sentences(texts, vocab, key=key)
    drawn = corpus.draw_segments(corpus.segments_of(ids, length, mode), per_doc, key=key)
    packed.write_packed(packing.number_segments(drawn, key=key), target)
    return packed.check_packed(qa.sparkSession, target)


def extract_and_damage(
    grads: DataFrame, weights: DataFrame, ks: Sequence[float], target: str, mode: str = "chunked",
    front: int = 0, back: int = 0, block_size: int = region.BLOCK_SIZE,
) -> DataFrame:
    """Gradients and weights to attribution, selections, statistics and damaged weights under
    ``target``; returns the layer statistics."""
    spark = grads.sparkSession
    product = grad_times_weight(grads.drop("shape"), weights)
    tensors.write_tensors(product.select("ckpt", "tensor", "shape", "block", "vals"), f"{target}/attribution")
    blocks = tensors.read_tensors(spark, f"{target}/attribution")
    meta = region.layout(blocks, front, back)
    select = {"chunked": region.select_chunked, "global": region.select_global}[mode]
    chosen = stage(select(blocks, meta, ks, block_size), "selection")
    stats = region.layer_stats(meta, chosen, ks)
    tensors.write_masks(chosen, f"{target}/masks")
    tensors.write_stats(stats, f"{target}/stats")
    tensors.write_selected(region.selected_indices(chosen, meta, ks, block_size), f"{target}/selected")
    tensors.write_preview(region.selected_preview(chosen, meta, ks), f"{target}/preview")
    shapes = region.masked_tensors(meta).join(meta.select("ckpt", "tensor", "shape"), ["ckpt", "tensor"]).select("tensor", "shape")
    damage.damage_variants(weights, tensors.read_masks(spark, f"{target}/masks"), block_size, shapes if "shape" in weights.columns else None).write.partitionBy(
        "ckpt", "side", "k"
    ).parquet(f"{target}/damaged")
    return stats

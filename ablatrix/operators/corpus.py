"""From rendered text to token segments: split, tokenise, cut, pack, sample."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as ar, chat, text as tx
from ..functions.hashing import order_hash
from ..session import null_safe_join
from . import tokens as tk
from .extraction import drop_blank

# Ids of the text-start and text-end marks unless a caller says otherwise.
BOS_ID = 1
EOS_ID = 2
UNKNOWN_ID = 0


def chat_rows(df: DataFrame, template: chat.ChatTemplate) -> DataFrame:
    """QA rows rendered with a chat template as ``content``.

    A missing field reads as empty, an explicit JSON null as ``None``. A line of the JSONL source
    that could not be parsed is its own content, with the reason in ``_error``.
    """
    def field(name: str) -> Column:
        if "null_fields" not in df.columns:
            return F.coalesce(name, F.lit(""))
        return F.when(F.array_contains("null_fields", name), F.lit("None")).otherwise(F.coalesce(name, F.lit("")))

    content = template.render(chat.qa_messages(field("context"), field("question"), field("answer")))
    error = F.lit(None).cast("string")
    if "_corrupt" in df.columns:
        broken = F.col("_corrupt").isNotNull()
        content = F.when(broken, F.col("_corrupt")).otherwise(content)
        error = F.when(broken, F.lit("not a JSON object"))
    return df.withColumns({"content": content, "_error": error})


def chat_turns(df: DataFrame, template: chat.ChatTemplate, key: str = "conv_id") -> DataFrame:
    """Multi-turn tables rendered turn by turn; a conversation's first turn carries the template's opening.

    Reading turns in order gives the conversation, so a conversation of any length is never
    gathered into one row.
    """
    body = template.message(F.col("role"), F.col("text"))
    if not template.opening:
        return df.withColumn("content", body)
    first = df.groupBy(key).agg(F.min("turn").alias("__first"))
    opening = F.when(F.col("turn") == F.col("__first"), F.lit(template.opening)).otherwise(F.lit(""))
    return null_safe_join(df, first, [key], "left").withColumn("content", F.concat(opening, body)).drop("__first")


def with_marks(sentences: Column, bos: int | None, eos: int | None) -> Column:
    """Put ``bos`` before the first and ``eos`` after the last sentence of ids."""
    out = sentences
    if bos is not None:
        out = tx.let(out, lambda s: F.transform(s, lambda x, i: F.when(i == 0, F.concat(F.array(F.lit(bos)), x)).otherwise(x)))
    if eos is not None:
        out = tx.let(
            out,
            lambda s: F.transform(
                s, lambda x, i: F.when(i == F.size(s) - 1, F.concat(x, F.array(F.lit(eos)))).otherwise(x)
            ),
        )
    return out


def sentences_of(df: DataFrame, column: str = "text", splitter: Callable[[Column], Column] = tx.split_sentences) -> DataFrame:
    """Texts with content, with their ``sentences``; texts without any are left out."""
    # Generated rather than projected, so that filters on the sentences do not split the text again.
    kept = drop_blank(df, column).select("*", F.explode(F.array(splitter(F.col(column)))).alias("sentences"))
    return kept.filter(F.size("sentences") > 0)


def token_sentences(
    df: DataFrame, vocab: DataFrame, column: str = "text", key: str = "doc_id",
    bos: int | None = None, eos: int | None = EOS_ID, local: bool | None = None,
) -> DataFrame:
    """``ids``: one array of ids per sentence, with the marks in place; the text is dropped."""
    split = sentences_of(df, column).withColumn(
        "tokens", F.transform("sentences", tk.word_tokens)
    ).drop(column, "sentences")
    ids = tk.encode_tokens(split, vocab, UNKNOWN_ID, key=key, local=local)
    return ids.withColumn("ids", with_marks(F.col("ids"), bos, eos))


def pieces_of(ids: Column, length: int) -> Column:
    """Sentences cut to at most ``length`` ids each."""
    return F.flatten(F.transform(ids, lambda s: ar.cut_fixed(s, length)))


def segments_of(df: DataFrame, length: int, mode: str = "drop") -> DataFrame:
    """``segments`` of at most ``length`` ids per document, replacing ``ids``.

    ``drop``: a document that does not fit one segment yields none. ``greedy``: consecutive
    pieces are packed into as many segments as needed.
    """
    if mode not in ("drop", "greedy"):
        raise ValueError("mode is drop or greedy")
    if mode == "drop":
        segments = ar.pack_or_drop(pieces_of(F.col("ids"), length), length)
        return df.withColumn("segments", segments).drop("ids")
    at, names = df.columns.index("ids"), ["segments" if c == "ids" else c for c in df.columns]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [ar.pack_greedy(c, length) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    packed = df.mapInArrow(pack, df.withColumnRenamed("ids", "segments").schema)
    return packed.select(*[c for c in names if c != "segments"], "segments")


def draw_segments(df: DataFrame, per_doc: int, seed: int = 2023, key: str = "doc_id") -> DataFrame:
    """``drawn``: each document's drawn segments in order of drawing, with their places; it replaces ``segments``.

    -1 takes all in order; up to 2 draws with replacement; above 2 takes the first, the last,
    then the others in seeded random order. All row-local: a document's draws depend on its key only.
    Documents without segments are left out.
    """
    n = F.size("segments")
    everything = F.sequence(F.lit(0), n - 1)
    if per_doc == -1:
        picks = everything
    elif per_doc <= 2:
        picks = F.transform(
            F.sequence(F.lit(1), F.lit(per_doc)),
            lambda j: F.pmod(order_hash(seed, F.col(key), j), n).cast("int"),
        )
    else:
        def priority(i: Column) -> Column:
            return F.when(i == 0, 0).when(i == n - 1, 1).otherwise(2)

        ranked = F.array_sort(
            F.transform(
                everything,
                lambda i: F.struct(
                    priority(i).alias("p"), order_hash(seed, F.col(key), i).alias("h"), i.alias("i")
                ),
            )
        )
        picks = F.transform(F.slice(ranked, 1, per_doc), lambda x: x["i"])
    drawn = F.transform(
        F.col("picks"), lambda i: F.struct(i.alias("seg"), F.get("segments", i).alias("tokens"))
    )
    if per_doc == 0:
        return df.limit(0).withColumn("drawn", F.array().cast("array<struct<seg:int,tokens:array<int>>>")).drop("segments")
    return df.filter(n > 0).withColumn("picks", picks).withColumn("drawn", drawn).drop("segments", "picks")


def sample_segments(df: DataFrame, per_doc: int, seed: int = 2023, key: str = "doc_id") -> DataFrame:
    """One row per drawn segment: ``draw`` (order of drawing), ``seg``, ``length`` and ``tokens``."""
    drawn = draw_segments(df, per_doc, seed, key)
    return (
        drawn.select(*[c for c in drawn.columns if c != "drawn"], F.posexplode("drawn").alias("draw", "x"))
        .select("*", "x.seg", F.size("x.tokens").alias("length"), "x.tokens")
        .drop("x")
    )


def boundary_stats(df: DataFrame, bos: int = BOS_ID, eos: int = EOS_ID, column: str = "tokens") -> DataFrame:
    """How many segments open with ``bos`` only, close with ``eos`` only, neither, or both."""
    opens, closes = ar.id_edges(F.col(column), bos, eos)
    return df.agg(
        F.count_if(opens & ~closes).alias("bos_only"),
        F.count_if(~opens & closes).alias("eos_only"),
        F.count_if(~opens & ~closes).alias("neither"),
        F.count_if(opens & closes).alias("both"),
    )

"""Texts to token ids and back.

Ids come from a vocabulary table, or from a tokenizer a user plugs in. With a vocabulary of
tokenizer size the lookup runs on Arrow batches in place (no shuffle, no per-row Python). Of a
vocabulary over the limit the tokens that are frequent in the texts are looked up in place, and
only the distinct others of each row are joined, so that no token is a hot key.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import stage

# Tasks get these functions by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A vocabulary up to this many entries and bytes is shipped to the tasks.
MAX_LOCAL_TOKENS = 400_000
MAX_LOCAL_BYTES = 64 * 2**20
# Of a larger one, so many frequent entries are, none longer than this.
FREQUENT = 1 << 16
MAX_FREQUENT_BYTES = 256
# Values a worker goes through at a time, whatever a batch holds, and that a partition of a join has.
SLICE_VALUES = 1 << 18
PARTITION_VALUES = 1 << 22

TOKEN = rf"{tx.WORD}+|[^\p{{L}}\p{{N}}_{tx.SPACE_BODY}]"


def word_tokens(c: Column) -> Column:
    """Runs of word characters, and single other characters that are not whitespace."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def fits_locally(vocab: DataFrame) -> bool:
    """Whether the vocabulary is small enough to be held by every task."""
    n, size = vocab.agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))
    ).first()
    return n <= MAX_LOCAL_TOKENS and size <= MAX_LOCAL_BYTES


def _local_vocab(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    table = vocab.select("token", F.col("id").cast("int")).toArrow()
    return table["token"].combine_chunks(), table["id"].combine_chunks()


def encode_tokens(
    df: DataFrame, vocab: DataFrame, unknown: int, column: str = "tokens", into: str = "ids",
    key: str = "doc_id", local: bool | None = None,
) -> DataFrame:
    """Map sentences of tokens (``array<array<string>>``) to ids; other columns pass through.

    ``vocab`` has columns ``token`` and ``id``; tokens it lacks get ``unknown``.
    """
    if local is None:
        local = fits_locally(vocab)
    if local:
        return _encode_in_place(df, vocab, unknown, column, into)
    return _encode_by_join(df, vocab, unknown, column, into)


def _encode_in_place(df, vocab, unknown, column, into):
    shipped = df.sparkSession.sparkContext.broadcast(_local_vocab(vocab))
    at = df.columns.index(column)
    schema = df.drop(column).withColumn(into, F.lit(None).cast("array<array<int>>")).schema

    def lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shipped.value
        for batch in _slices(batches, at, MAX_LOCAL_TOKENS):
            sentences = batch.column(at)
            flat = sentences.flatten()
            found = pc.index_in(flat.flatten(), value_set=words)
            flat_ids = pc.fill_null(ids.take(found), unknown).cast(pa.int32())
            inner = pa.ListArray.from_arrays(_offsets(flat), flat_ids)
            outer = pa.ListArray.from_arrays(_offsets(sentences), inner)
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, outer], names=[*names, into])

    return df.mapInArrow(lookup, schema)


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())


def _leaves(column: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """The offsets of each level of lists, and the values below."""
    levels = []
    while pa.types.is_list(column.type):
        levels.append(_offsets(column))
        column = column.flatten()
    return levels, column


def _nested(levels: list[pa.Array], values: pa.Array) -> pa.Array:
    for offsets in reversed(levels):
        values = pa.ListArray.from_arrays(offsets, values)
    return values


def _row_ends(levels: list[pa.Array]) -> np.ndarray:
    """Where the values of each row begin and end among all values."""
    ends = levels[0].to_numpy()
    for offsets in levels[1:]:
        ends = offsets.to_numpy()[ends]
    return ends


def _slices(batches: Iterable[pa.RecordBatch], at: int, most: int = SLICE_VALUES) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of rows with at most ``most`` values in the arrays of a column, or of one row."""
    for batch in batches:
        ends, row = _row_ends(_leaves(batch.column(at))[0]), 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def frequent_values(df: DataFrame, column: str, most: int = FREQUENT) -> DataFrame:
    """The values that occur most inside the arrays of a column, as ``v`` and at least so often as ``n`` says.

    Each task keeps a summary of ``most`` counters (Misra-Gries): a new value beyond them takes the least count
    off all. Summaries add up, and what a task saw more often than in one of ``most`` parts of its values is in.
    """
    leaf = df.schema[column].dataType
    while leaf.typeName() == "array":
        leaf = leaf.elementType

    def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in _slices(batches, 0):
            kind, values = batch.column(0).type, _leaves(batch.column(0))[1]
            if pa.types.is_string(values.type):
                values = values.filter(pc.less_equal(pc.binary_length(values), MAX_FREQUENT_BYTES))
            found = pc.value_counts(values)
            for v, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                counters[v] = counters.get(v, 0) + n
            if len(counters) > 2 * most:
                least = sorted(counters.values(), reverse=True)[most]
                counters = {v: n - least for v, n in counters.items() if n > least}
        if counters:
            while pa.types.is_list(kind):
                kind = kind.value_type
            yield pa.RecordBatch.from_arrays([pa.array(counters, kind), pa.array(counters.values(), pa.int64())], names=["v", "n"])

    counts = df.select(column).mapInArrow(summarise, f"v {leaf.simpleString()}, n bigint").filter("v is not null")
    return counts.groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "v").limit(most)


def _look_up(df: DataFrame, known: DataFrame, column: str, into: str, default, most: int = FREQUENT) -> DataFrame:
    """Replace the values in the arrays of a column by what ``known`` (v, found) has for them, else by ``default``.

    Frequent values are looked up in place, in a table of bounded size. Of the others each row asks once for
    each distinct one by a join, in which no value is hot any more.
    """
    number = f"__row_{column}"
    # Whichever values are taken for frequent, the answers are the same: the rows need not be kept for the next pass.
    often = frequent_values(df, column, most).select("v").join(known, "v", "left").toArrow()
    rows = df.withColumn(number, F.monotonically_increasing_id())
    shipped = df.sparkSession.sparkContext.broadcast((often["v"].combine_chunks(), pc.fill_null(often["found"], default).combine_chunks()))
    at = rows.columns.index(column)
    kept = [c for c in rows.columns if c != column]
    answer = known.schema["found"].dataType.simpleString()
    asked_kind = rows.schema[column].dataType.simpleString()
    leaf = asked_kind.replace("array<", "").rstrip(">")
    shape = rows.select(*kept).withColumns({
        "__found": F.lit(None).cast(asked_kind.replace(leaf, answer)), "__rare": F.lit(None).cast(f"array<{leaf}>"),
        "__at": F.lit(None).cast(asked_kind.replace(leaf, "int")), "__values": F.lit(None).cast("int"),
    }).schema

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, answers = shipped.value
        for batch in _slices(batches, at):
            levels, flat = _leaves(batch.column(at))
            place = pc.index_in(flat, value_set=values.cast(flat.type))
            # Rare values are numbered from 1 within their row, each distinct one once.
            ends = _row_ends(levels)
            missing = pc.is_null(place).to_numpy(zero_copy_only=False)
            at_missing = missing.nonzero()[0]
            names = flat.take(pa.array(at_missing)).dictionary_encode(null_encoding="encode")
            row = np.searchsorted(ends, at_missing, side="right") - 1
            different = max(1, len(names.dictionary))
            pairs, pair_of = np.unique(row * different + names.indices.to_numpy(), return_inverse=True)
            first = np.searchsorted(pairs, np.arange(batch.num_rows + 1) * different)
            numbers = np.zeros(len(flat), np.int32)
            numbers[at_missing] = pair_of - first[row] + 1
            new = [
                _nested(levels, answers.take(place)),
                pa.ListArray.from_arrays(pa.array(first, pa.int32()), names.dictionary.take(pa.array(pairs % different))),
                _nested(levels, pa.array(numbers, mask=~missing)), pa.array(np.diff(ends), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, "__found", "__rare", "__at", "__values"])

    looked = stage(rows.mapInArrow(look, shape), "looked")
    # So many partitions that none has to be sorted on disk, whatever the session's number is.
    total = looked.agg(F.sum(F.col("__values").cast("bigint"))).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_VALUES))
    asked = looked.select(number, F.posexplode("__rare").alias("j", "v")).join(known, "v", "left")
    answers = asked.repartition(parts, number).groupBy(number).agg(F.array_sort(F.collect_list(F.struct("j", "found"))).alias("__answers"))
    looked = looked.drop("__rare", "__values").repartition(parts, number)
    fallback = F.lit(default).cast(answer)

    def fill(found: Column, place: Column, depth: int) -> Column:
        if depth:
            return F.zip_with(found, place, lambda f, p: fill(f, p, depth - 1))
        return F.when(place.isNull(), found).otherwise(F.coalesce(F.get("__answers", place - 1)["found"], fallback))

    depth = asked_kind.count("array<")
    filled = looked.join(answers, number, "left").withColumn(into, fill(F.col("__found"), F.col("__at"), depth))
    return filled.select(*[c for c in kept if c != number], into)


def _encode_by_join(df, vocab, unknown, column, into):
    known = vocab.select(F.col("token").alias("v"), F.col("id").cast("int").alias("found"))
    empty = F.array().cast("array<array<string>>")
    return _look_up(df.withColumn(column, F.coalesce(column, empty)), known, column, into, unknown)


def decode_ids(
    df: DataFrame, vocab: DataFrame, special: Iterable[int] = (), column: str = "ids",
    into: str = "text", key: str = "doc_id", local: bool | None = None,
) -> DataFrame:
    """Ids to text, tokens joined by a space and special ids left out; ``ids`` is dropped."""
    plain = df.withColumn(column, F.filter(column, lambda x: ~x.isin(list(special)))) if special else df
    if local is None:
        local = fits_locally(vocab)
    if local:
        return _decode_in_place(plain, vocab, column, into)
    return _decode_by_join(plain, vocab, column, into)


def _decode_in_place(df, vocab, column, into):
    shipped = df.sparkSession.sparkContext.broadcast(_local_vocab(vocab))
    at = df.columns.index(column)
    schema = df.drop(column).withColumn(into, F.lit(None).cast("string")).schema

    def lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = shipped.value
        for batch in _slices(batches, at, MAX_LOCAL_TOKENS):
            lists = batch.column(at)
            spelled = words.take(pc.index_in(lists.flatten().cast(pa.int32()), value_set=ids))
            spelled = pa.ListArray.from_arrays(_offsets(lists), pc.fill_null(spelled, ""))
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*kept, pc.binary_join(spelled, " ")], names=[*names, into]
            )

    return df.mapInArrow(lookup, schema)


def _decode_by_join(df, vocab, column, into):
    known = vocab.select(F.col("id").cast("int").alias("v"), F.col("token").alias("found"))
    ids = df.withColumn(column, F.coalesce(F.col(column).cast("array<int>"), F.array().cast("array<int>")))
    words = _look_up(ids, known, column, "__words", "")
    return words.withColumn(into, F.array_join("__words", " ")).drop("__words")


# Tokenizers and sentence splitters a user adds: name -> function that builds one per worker.
_TOKENIZERS: dict[str, Callable[[], Callable[[str], list[int]]]] = {}
_SPLITTERS: dict[str, Callable[[], Callable[[str], list[str]]]] = {}


def register_tokenizer(name: str, build: Callable[[], Callable[[str], list[int]]]) -> None:
    _TOKENIZERS[name] = build


def register_splitter(name: str, build: Callable[[], Callable[[str], list[str]]]) -> None:
    _SPLITTERS[name] = build


def _plugged(build: Callable[[], Callable], result_type: str) -> Callable[[Column], Column]:
    @F.pandas_udf(result_type)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first = next(batches, None)
        if first is None:
            return
        one = build()
        for batch in chain([first], batches):
            yield batch.map(lambda items: one(items))

    return run


def encode_with(name: str) -> Callable[[Column], Column]:
    """Sentences (``array<string>``) to ids (``array<array<int>>``) with a registered tokenizer."""
    build = _TOKENIZERS[name]

    def per_row():
        encode = build()
        return lambda sentences: [encode(s) for s in sentences]

    return _plugged(per_row, "array<array<int>>")


def split_with(name: str) -> Callable[[Column], Column]:
    """Text to sentences with a registered splitter."""
    return _plugged(_SPLITTERS[name], "array<string>")

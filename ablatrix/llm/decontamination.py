"""Benchmark decontamination: a broadcast hash set of test n-grams, held against all token windows.

Words of the benchmark get numbers; a text becomes a row of numbers, 0 for words no item has. A
window without a 0 whose rolling hash is in the set is compared number by number, so a hit is
always a true one. The benchmark is cut into blocks of bounded size. A single block is broadcast and
held against the documents in one pass without a shuffle. Of several, one at a time is read, broadcast,
held against numbered documents and released; the rows it hits are written, and join the documents
for the pass of the last block.

Defined cases: a null or wordless text has no words and no hits; an item with a null text or
without words has no window; items of equal text are reported each by its own id; a repeated item
row counts once; an item without id marks words but is not listed; an empty benchmark leaves all
documents clean; an empty table gives no rows; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import fresh, opened, shipped, whole

N = 13
#: Benchmark text that is broadcast at once.
BLOCK_BYTES = 32 * 2**20
#: Words hashed at once within a task.
CHUNK_WORDS = 1 << 20

#: Lower case for A-Z; a blank for every ASCII character that is neither letter nor digit.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: An odd multiplier for rolling hashes modulo 2**64.
BASE = 0x9E3779B97F4A7C15


def folded_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ") if text else []


class Grams:
    """The distinct (window, item) entries of one size: hash, begin in ``ids`` and item, in order of hash."""

    def __init__(self, texts: list[tuple[np.ndarray, int]], size: int):
        lengths = np.array([len(ids) for ids, _ in texts])
        counts = lengths - size + 1
        # A text's windows begin where it does in ids; the gaps between texts are no begins.
        shift = np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts)
        self.ids = np.concatenate([ids for ids, _ in texts])
        begins = np.arange(counts.sum()) + np.repeat(shift, counts)
        owners = np.repeat(np.array([owner for _, owner in texts], np.int32), counts)
        hashes = rolling(self.ids, begins, size)
        order = np.lexsort((owners, hashes))
        hashes, begins, owners = hashes[order], begins[order].astype(np.int32), owners[order]
        #: Whether an entry's window is that of the entry before.
        same = np.zeros(len(hashes), bool)
        after = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        same[after] = True
        for j in range(size):
            same[after] &= self.ids[begins[after] + j] == self.ids[begins[after - 1] + j]
        kept = np.ones(len(hashes), bool)
        kept[1:] = ~(same[1:] & (owners[1:] == owners[:-1]))
        self.size, self.hashes, self.begins, self.owners, self.same = size, hashes[kept], begins[kept], owners[kept], same[kept]
        # One bit per hash remainder turns most windows away before the search.
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self.hashes >> np.uint64(42)] = True

    def owners_of(self, window: np.ndarray, first: int, end: int) -> np.ndarray:
        """Items of those of the entries ``first`` to ``end``, all of one hash, that are this window."""
        if self.same[first + 1:end].all():
            begin = self.begins[first]
            return self.owners[first:end] if (self.ids[begin:begin + self.size] == window).all() else self.owners[:0]
        true = np.ones(end - first, bool)
        for j in range(self.size):
            true &= self.ids[self.begins[first:end] + j] == window[j]
        return self.owners[first:end][true]


def rolling(ids: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(begins), np.uint64)
    for j in range(size):
        h = h * np.uint64(BASE) + ids[begins + j].astype(np.uint64)
    return h * np.uint64(BASE)


class Windows:
    """The windows of a block of items, by size and rolling hash."""

    def __init__(self, items: Iterable[tuple[str | None, str]], n: int):
        self.numbers: dict[bytes, int] = {}
        self.items: list[str] = []
        texts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            words = [w for w in folded_words(text) if w]
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], np.int32)
            owner = -1
            if item_id is not None:
                owner = len(self.items)
                self.items.append(item_id)
            texts.setdefault(min(n, len(ids)), []).append((ids, owner))
        self.sizes = {size: Grams(parts, size) for size, parts in texts.items()}

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(begin, size, items) of every window of ``ids`` that is in the set."""
        zeros = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, grams in self.sizes.items():
            count = len(ids) - size + 1
            if count <= 0:
                continue
            begins = np.flatnonzero(zeros[size:] == zeros[:count])
            for part in np.array_split(begins, len(begins) // CHUNK_WORDS + 1):
                h = rolling(ids, part, size)
                near = grams.filter[h >> np.uint64(42)]
                part, h = part[near], h[near]
                firsts = np.searchsorted(grams.hashes, h)
                ends = np.searchsorted(grams.hashes, h, side="right")
                known = ends > firsts
                for begin, first, end in zip(part[known].tolist(), firsts[known].tolist(), ends[known].tolist()):
                    owners = grams.owners_of(ids[begin:begin + size], first, end)
                    if len(owners):
                        yield begin, size, {self.items[i] for i in owners.tolist() if i >= 0}


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``limit`` bytes of text, one item at least."""
    block, size = [], 0
    items = benchmark.select(F.col(item).cast("string").alias("item"), whole(text).alias("text"))
    for r in items.filter(F.col("text") != "").toLocalIterator():
        n = len(r["text"].encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((r["item"], r["text"]))
        size += n
    if block:
        yield block


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    n: int = N, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add ``n_words``, ``hits`` (begin and end word of each hit run, in order), ``items`` (sorted ids), ``n_hit``."""
    names = ["n_words", "hits", "items"]
    df = docs.drop(*[c for c in docs.columns if c.lower() in names])
    found = {
        "n_words": F.lit(0).cast("bigint"),
        "hits": F.array().cast("array<struct<begin:int,end:int>>"),
        "items": F.array().cast("array<string>"),
    }
    todo = blocks(benchmark, item, item_text, block_bytes)
    windows = Windows(next(todo, []), n)
    row, parts, numbered = "", [], None
    for block in todo:
        # Another block follows: this one's hits are written, and it is given up.
        if numbered is None:
            row, = fresh(df.withColumns(found), "row")
            numbered = stage(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
        box = shipped(docs.sparkSession, windows)
        read = numbered.select(row, text).withColumns(found)
        hit = read.mapInArrow(_scanner(box, 1), read.schema).filter(F.size("items") + F.size("hits") > 0)
        parts.append(stage(hit.select(row, "hits", "items"), "hits"))
        box.destroy()
        del windows, box
        windows = Windows(block, n)
    if numbered is None:
        df = df.withColumns(found)
    else:
        before = reduce(DataFrame.union, parts).groupBy(row).agg(
            F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
        df = numbered.join(before, row, "left").select(
            *df.columns, found["n_words"].alias("n_words"),
            *[F.coalesce(F.col(c), found[c]).alias(c) for c in ("hits", "items")],
        )
    df = df.mapInArrow(_scanner(shipped(docs.sparkSession, windows), df.columns.index(text)), df.schema)
    return df.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["end"] - h["begin"]))


def _scanner(box, at: int):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = opened(box)
        number = windows.numbers.get
        for whole_batch in batches:
            for batch in (whole_batch.slice(i, 256) for i in range(0, whole_batch.num_rows, 256)):
                counts, spans, owners = [], [], []
                hits = batch.column("hits").to_pylist()
                items = batch.column("items").to_pylist()
                for t, old, had in zip(batch.column(at).to_pylist(), hits, items):
                    words = folded_words(t or "")
                    ids = np.array([number(w, 0) for w in words if w], np.int64)
                    found = [*windows.hits(ids)] if ids.any() else []
                    counts.append(len(ids))
                    spans.append(union([(h["begin"], h["end"]) for h in old] + [(b, b + s) for b, s, _ in found]))
                    owners.append(sorted(set(had).union(*[o for _, _, o in found])))
                new = {
                    "n_words": pa.array(counts, pa.int64()),
                    "hits": pa.array([[{"begin": b, "end": e} for b, e in s] for s in spans], batch.schema.field("hits").type),
                    "items": pa.array(owners, batch.schema.field("items").type),
                }
                columns = [new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return scan


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def is_contaminated() -> Column:
    """At least one hit, and a twentieth of the words hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each hit run."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(FOLD)
    bounds, at = [], 0
    for w in folded.split(b" "):
        if w:
            bounds.append((at, at + len(w)))
        at += len(w) + 1
    kept, last = [], 0
    for begin, end in spans:
        kept.append(raw[last:bounds[begin][0]])
        last = bounds[end - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """The clean documents; or, with ``remove="spans"``, all documents without the passages that are hit.

    Columns are those of ``docs``.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    kept = fresh(docs.select(*[F.lit(1).alias(c) for c in ("n_words", "hits", "items", "n_hit")]), *docs.columns)
    back = dict(zip(kept, docs.columns))  # columns of the result's names step aside meanwhile
    hidden = docs.select(*[F.col(c).alias(k) for k, c in back.items()])
    found = find_hits(hidden, benchmark, {c: k for k, c in back.items()}[text], **options)
    if remove == "documents":
        return found.filter(~is_contaminated()).select(*[F.col(k).alias(c) for k, c in back.items()])
    at = list(back.values()).index(text)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                without_spans(t, [(h["begin"], h["end"]) for h in hs]) if hs else t
                for t, hs in zip(batch.column(at).to_pylist(), batch.column("hits").to_pylist())
            ]
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(back))]
            yield pa.RecordBatch.from_arrays(columns, names=list(back))

    cut_docs = found.select(*kept, "hits").mapInArrow(cut, hidden.schema)
    return cut_docs.select(*[F.col(k).alias(c) for k, c in back.items()])


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def brute_force(docs: list[str | None], benchmark: list[tuple[str, str | None]], n: int = N) -> list[tuple[int, int, list[str], str]]:
    """(n_words, n_hit, items, digest) per text, by comparing the words of all windows."""
    windows: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in benchmark:
        own = [w for w in folded_words(text or "") if w]
        size = min(n, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            windows.setdefault(size, {}).setdefault(tuple(own[i:i + size]), set()).add(item)
    out = []
    for text in docs:
        words = [w for w in folded_words(text or "") if w]
        hit, items = set(), set()
        for size, known in windows.items():
            for j in range(len(words) - size + 1):
                owners = known.get(tuple(words[j:j + size]))
                if owners:
                    hit.update(range(j, j + size))
                    items |= owners
        ordered = sorted(i for i in items if i is not None)
        out.append((len(words), len(hit), ordered, hashlib.sha256(",".join(ordered).encode()).hexdigest()))
    return out

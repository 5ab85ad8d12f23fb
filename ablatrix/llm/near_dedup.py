"""SimHash near-duplicates, exact, through vantage-point trees.

A fingerprint bit is the majority of the bits of the text's shingle hashes. Distinct fingerprints
within a few bits of each other are linked; a group is a connected component.

A tree of vantage points, grown on a bounded sample, parts the space of fingerprints into shards
by Hamming distance: near ones of a vantage point to the left, far ones to the right. A fingerprint
is a member of one shard. By the triangle inequality only those whose distance lies within the link
radius of a node's boundary can have partners on the other side, so copies of these alone go there as
queries. Each shard grows a tree of its own over what it got, prunes by the same bounds down to
small leaves, compares there bit by bit, and emits a spanning forest of the links, never all pairs.
Components are then joined across shards by label propagation over those star-shaped links.

Defined cases: a text of fewer words than a shingle is one shingle, a null or wordless text has
fingerprint 0, linked like any other; equal texts share a fingerprint and so a group; rows with a
null id belong to a group but never name it unless no other row does (then its id is null); an empty
table gives no rows. ``near_duplicates`` keeps key and result columns only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir, stage
from .common import fresh, opened, shipped, slices

RADIUS = 3
SHINGLE = 3
#: Distinct fingerprints a shard should hold as members, and those the tree is grown on.
SHARD_MEMBERS = 20_000
SAMPLE = 20_000
#: Fingerprints below which a shard's tree stops and compares.
LEAF = 64
#: Rows of a block of comparisons.
TILE = 2048
#: Asked-for bound on rounds; a chain of links of any length needs about its logarithm.
MAX_ROUNDS = 100


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), seed)]
    return [digest(b" ".join(words[i:i + size]), seed) for i in range(len(words) - size + 1)]


def simhash(hashes: list[int]) -> int:
    """Bits set in over half of the hashes."""
    if not hashes:
        return 0
    h = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for part in np.array_split(h, len(h) // (1 << 16) + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Replace the text by its fingerprint as a signed 64-bit integer."""
    at = docs.columns.index(text)
    others = [c for c in docs.columns if c not in (text, into)]

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([simhash(shingle_hashes(t, size)) for t in batch.column(at).to_pylist()], np.uint64)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=[*others, into])

    schema = docs.select(*others).withColumn(into, F.lit(0).cast("long")).schema
    return docs.mapInArrow(compute, schema)


def distances(fps: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ point)


class VantageTree:
    """Inner nodes as (vantage point, largest distance of the left side); leaves by number."""

    def __init__(self, sample: np.ndarray, leaf: int):
        """Split until a side has at most ``leaf`` of the sample."""
        self.leaves = 0
        self.root = self._grow(np.unique(sample), leaf)

    def _grow(self, fps: np.ndarray, leaf: int):
        split = median_split(fps) if len(fps) > max(1, leaf) else None
        if split is None:
            self.leaves += 1
            return self.leaves - 1
        point, bound, near = split
        return point, bound, self._grow(fps[near], leaf), self._grow(fps[~near], leaf)

    def deal(self, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int, bool]]:
        """(places in ``fps``, shard, whether as members) for members and the queries they send.

        A pair is met from one side: members cross to the right only; queries, which are no
        longer members anywhere, go wherever a partner can be.
        """
        todo = [(self.root, np.arange(len(fps)), True)]
        while todo:
            node, at, member = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield at, node, member
                continue
            point, bound, left, right = node
            d = distances(fps[at], point).astype(np.int64)
            if member:
                todo += [(left, at[d <= bound], True), (right, at[d > bound], True)]
                todo.append((right, at[(d <= bound) & (d + radius > bound)], False))
            else:
                todo += [(left, at[d - radius <= bound], False), (right, at[d + radius > bound], False)]


def median_split(fps: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point, the median distance and who is near; None if all are equally far."""
    for point in fps[:: max(1, len(fps) // 3)][:4]:
        d = distances(fps, point)
        bound = int(np.median(d))
        for b in (bound, bound - 1):
            near = d <= b
            if near.any() and not near.all():
                return point, b, near
    return None


class Groups:
    """Labels of places, merged group by group; the smaller group is relabelled."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.places: dict[int, list[np.ndarray]] = {}
        self.size = np.ones(n, np.int64)

    def merge(self, places: np.ndarray) -> None:
        labels = np.unique(self.label[places])
        if len(labels) < 2:
            return
        into = int(labels[np.argmax(self.size[labels])])
        gathered = self.places.setdefault(into, [np.array([into])])
        for x in labels.tolist():
            if x != into:
                for part in self.places.pop(x, [np.array([x])]):
                    self.label[part] = into
                    gathered.append(part)
                self.size[into] += self.size[x]

    def linked(self) -> Iterator[np.ndarray]:
        for parts in self.places.values():
            yield np.concatenate(parts)


def shard_links(members: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star-shaped links (fingerprint, root) that span what members and queries of a shard link to.

    Queries are compared with members only; members also with each other.
    """
    fps = np.concatenate([members, queries])
    groups, n = Groups(len(fps)), len(members)
    todo = [(np.arange(n), np.arange(n, len(fps)))]
    while todo:
        own, asked = todo.pop()
        if not len(own):
            continue
        split = median_split(fps[own]) if len(own) > LEAF else None
        if split is None:
            compare(fps, own, np.concatenate([own, asked]), radius, groups)
            continue
        point, bound, near = split
        d = distances(fps[own], point).astype(np.int64)
        q = distances(fps[asked], point).astype(np.int64)
        crossing = own[near & (d + radius > bound)]
        todo.append((own[near], asked[q - radius <= bound]))
        todo.append((own[~near], np.concatenate([asked[q + radius > bound], crossing])))
    nodes, roots = [], []
    for places in groups.linked():
        values = np.unique(fps[places])
        nodes.append(values[1:])
        roots.append(np.full(len(values) - 1, values[0]))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *nodes]), np.concatenate([none, *roots])


def compare(fps: np.ndarray, own: np.ndarray, others: np.ndarray, radius: int, groups: Groups) -> None:
    """Merge the groups of all pairs within the radius, tile by tile."""
    for rows in np.array_split(own, len(own) // TILE + 1):
        for columns in np.array_split(others, len(others) // TILE + 1):
            close = np.bitwise_count(fps[rows][:, None] ^ fps[columns][None, :]) <= radius
            counts = close.sum(axis=1)
            # Every row of own meets itself among the others, so one hit may be no pair.
            for i in np.flatnonzero(counts):
                groups.merge(np.append(columns[close[i]], rows[i]))


def links(distinct: DataFrame, radius: int, shard_members: int) -> DataFrame:
    """``node, root``: star-shaped links between the distinct fingerprints in column ``fp``."""
    spark = distinct.sparkSession
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp")).limit(SAMPLE).toArrow()["fp"].to_numpy().view(np.uint64)
    leaf = max(8, ceil(len(sample) * shard_members / max(1, total)))
    box = shipped(spark, VantageTree(sample, leaf))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = opened(box)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at, shard, member in tree.deal(fps, radius):
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array(np.full(len(at), shard, np.int32)), "member": pa.array(np.full(len(at), member)),
                    "fp": pa.array(fps[at].view(np.int64)),
                })

    def search(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy().view(np.uint64)
        member = group["member"].to_numpy()
        nodes, roots = shard_links(fps[member], fps[~member], radius)
        return pa.table({"node": pa.array(nodes.view(np.int64)), "root": pa.array(roots.view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, member boolean, fp long")
    return dealt.groupBy("shard").applyInArrow(search, "node long, root long")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of the connected components of ``node, root`` links; every node but the roots.

    Large-star and small-star rounds: each node's larger, then smaller neighbours are tied to its
    smallest one, by aggregation and join, so that a hub is never gathered in one task.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def tied(pairs: DataFrame) -> DataFrame:
        """(a, b) pairs with the smallest b of each a, a itself included."""
        least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        return pairs.join(least, "a")

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()

    current = edges.filter("node <> root").distinct().checkpoint()
    before = state(current)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            return current
        both = current.select(F.col("node").alias("a"), F.col("root").alias("b")).union(
            current.select(F.col("root").alias("a"), F.col("node").alias("b"))
        )
        large = tied(both).filter("b > a").select(F.col("b").alias("node"), F.col("m").alias("root")).distinct()
        down = large.select(
            F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")
        )
        small = tied(down)
        current = small.select(F.col("b").alias("node"), F.col("m").alias("root")).union(
            small.select(F.col("a").alias("node"), F.col("m").alias("root"))
        ).filter("node <> root").distinct().checkpoint()
        after = state(current)
        if after == before:
            return current
        before = after
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")


def components(rows: DataFrame, radius: int = RADIUS, shard_members: int = SHARD_MEMBERS) -> DataFrame:
    """``fp, component``: per distinct ``fp`` the smallest ``first`` of all rows reachable from it."""
    distinct = stage(rows.groupBy("fp").agg(F.min("first").alias("first")), "fingerprints")
    roots = connected(links(distinct, radius, shard_members))
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    named = distinct.join(linked, distinct["fp"] == linked["node"]).select("fp", "root", "first")
    smallest = named.groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(smallest, "root").select(F.col("fp").alias("node"), "component")
    return distinct.join(named, distinct["fp"] == named["node"], "left").select(
        "fp", F.coalesce("component", "first").alias("component")
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, fingerprint`` (16 hex digits) and ``component_id``, the smallest key of the group."""
    rows = docs.select(F.col(key).alias("first"), F.col(text).alias("text"))
    rows = stage(fingerprints(rows), "simhash")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(components(rows, **options), "fp").select(
        F.col("first").alias(key), hexed.alias("fingerprint"), F.col("component").alias("component_id")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest key of each group; of equal keys one. Columns are those of ``docs``."""
    row, = fresh(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    narrow = numbered.select(
        F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.col(row).alias("r")).alias("first"),
        F.col(text).alias("text"),
    )
    kept = components(stage(fingerprints(narrow), "simhash"), **options).select(F.col("component")["r"].alias(row))
    return numbered.join(kept.distinct(), row, "left_semi").select(*docs.columns)

"""Merkle dataset manifest: leaf places from ranks in bitmaps, trees from keyed arrays of slots.

Each group's keys are kept as bitmaps of 4096 keys, built per batch, merged by union and compressed
to the lesser of a sorted array and a bitmap with a directory of counts before each word. The counts
of all bitmaps before one, summed in parallel, are its base; base and rank of a key within its bitmap
give its leaf's slot, so leaves are never sorted by key. Slots fall into blocks of 4096; a block's
digests, an array in order of slots, are reduced four levels at once, the results are the slots of the
next round, and on the way back each block hands its nodes' paths down to the blocks below.

Digests are lowercase hex sha256, and inputs are joined as such text. While a group has more than
one node, every eight consecutive ones (the last run may have fewer) become their digest.

Defined cases: a null field is ``-``; a null group is a group of its own and comes first; a null key
comes before all keys of its group; rows of one key follow each other in order of their leaves, and
equal rows have equal leaves in neighbouring slots; a lone leaf is its group's subroot, a lone subroot
the root; an empty table gives no rows. Keys are integers: other types are cast to long, and text
that is none raises an error. Columns of ``docs`` other than those named take no part, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.running import id_levels, running_sums
from ..session import null_safe_join, stage

#: Nodes that become one, and levels reduced at once in a block.
FAN = 8
DEPTH = 4
BLOCK_BITS = 12
assert FAN**DEPTH == 1 << BLOCK_BITS

#: Keys of one bitmap; and how many of them are kept as an array, which is smaller then.
CHUNK_BITS = 12
ARRAY_KEYS = 320
#: The chunk of null keys lies before all others.
NULL_CHUNK = -(2**62)


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


# Bitmaps -----------------------------------------------------------------------------------------


def container(lows: np.ndarray) -> bytes:
    """Sorted distinct places within a chunk: an array, or words and the counts before each."""
    if len(lows) <= ARRAY_KEYS:
        return b"a" + lows.astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK_BITS, bool)
    bits[lows] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    counts = np.bitwise_count(words).cumsum()
    return b"b" + words.tobytes() + np.concatenate([[0], counts[:-1]]).astype("<u2").tobytes()


def places(data: bytes) -> np.ndarray:
    if data[:1] == b"a":
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    words = np.frombuffer(data, np.uint8, (1 << CHUNK_BITS) // 8, 1)
    return np.flatnonzero(np.unpackbits(words, bitorder="little"))


def rank(data: bytes, lows: np.ndarray) -> np.ndarray:
    """How many places of the container lie before each of ``lows``."""
    if data[:1] == b"a":
        return np.searchsorted(np.frombuffer(data, "<u2", offset=1), lows)
    n = (1 << CHUNK_BITS) // 64
    words = np.frombuffer(data[1:1 + 8 * n], "<u8")
    before = np.frombuffer(data[1 + 8 * n:], "<u2").astype(np.int64)
    word = lows >> 6
    below = (np.uint64(1) << (lows & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(words[word] & below)


PARTS = "grp long, chunk long, data binary, more array<struct<low:int,copies:long>>"
CONTAINERS = f"{PARTS}, total long"


def _more(lows: np.ndarray, copies: np.ndarray) -> list[dict[str, int]]:
    """The places that stand for several rows, with the rows beyond the first."""
    at = np.flatnonzero(copies > 1)
    return [{"low": int(a), "copies": int(c) - 1} for a, c in zip(lows[at], copies[at])]


def _build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of a batch's distinct keys."""
    for batch in batches:
        if not batch.num_rows:
            continue
        grp, chunk, low, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "chunk", "low", "copies"))
        order = np.lexsort((low, chunk, grp))
        grp, chunk, low, copies = grp[order], chunk[order], low[order], copies[order]
        begins = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (chunk[1:] != chunk[:-1])]))
        ends = [*begins[1:].tolist(), len(grp)]
        parts = [(container(low[a:b]), _more(low[a:b], copies[a:b])) for a, b in zip(begins, ends)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(grp[begins]), pa.array(chunk[begins]), pa.array([p[0] for p in parts], pa.binary()),
                pa.array([p[1] for p in parts], pa.list_(pa.struct([("low", pa.int32()), ("copies", pa.int64())]))),
            ],
            names=["grp", "chunk", "data", "more"],
        )


def _merge(table: pa.Table) -> pa.Table:
    """The union of a chunk's bitmaps: at most 4096 keys, in as many parts at most."""
    bits = np.zeros(1 << CHUNK_BITS, bool)
    for data in table["data"].to_pylist():
        bits[places(data)] = True
    more = [m for own in table["more"].to_pylist() for m in own]
    lows = np.flatnonzero(bits)
    total = len(lows) + sum(m["copies"] for m in more)
    rows = [{
        "grp": table["grp"][0].as_py(), "chunk": table["chunk"][0].as_py(), "data": container(lows),
        "more": sorted(more, key=lambda m: m["low"]), "total": total,
    }]
    return pa.Table.from_pylist(rows, pa.schema([*table.schema, ("total", pa.int64())]))


def _slots(keys: pa.Table, bitmap: pa.Table) -> pa.Table:
    """Rank queries: the slots of a chunk's keys."""
    low = keys["low"].to_numpy().astype(np.int64)
    slot = bitmap["base"][0].as_py() + rank(bitmap["data"][0].as_py(), low)
    if more := bitmap["more"][0].as_py():
        extra = np.concatenate([[0], np.cumsum([m["copies"] for m in more])])
        slot = slot + extra[np.searchsorted([m["low"] for m in more], low)]
    slot = pa.array(slot, pa.int64())
    return pa.table({"grp": keys["grp"], "key": keys["key"], "slot": slot, "copies": keys["copies"], "leaf": keys["leaf"], "other": keys["other"]})


def with_slots(leaves: DataFrame) -> DataFrame:
    """``grp``, ``slot``, ``key``, ``leaf``, ``other`` from ``grp``, ``key``, ``leaf``, ``other``.

    Rows of one key are counted before anything is moved, so a key with very many rows is a key like any other.
    """
    chunk = F.coalesce(F.shiftright("key", CHUNK_BITS), F.lit(NULL_CHUNK))
    low = F.coalesce(F.col("key").bitwiseAND((1 << CHUNK_BITS) - 1), F.lit(0)).cast("int")
    keys = stage(
        leaves.groupBy("grp", "key").agg(F.count("*").alias("copies"), F.min("leaf").alias("leaf"), F.min("other").alias("other"))
        .withColumns({"chunk": chunk, "low": low}),
        "keys",
    )
    built = keys.select("grp", "chunk", "low", "copies").mapInArrow(_build, PARTS)
    bitmaps = stage(built.groupBy("grp", "chunk").applyInArrow(_merge, CONTAINERS), "bitmaps")
    bases = running_sums(bitmaps.select("grp", "chunk", "total"), ["chunk"], id_levels("chunk"), {"base": F.col("total")}, by=["grp"])
    directory = bitmaps.join(bases.select("grp", "chunk", "base"), ["grp", "chunk"])
    ranked = keys.groupBy("grp", "chunk").cogroup(directory.groupBy("grp", "chunk")).applyInArrow(
        _slots, "grp long, key long, slot long, copies long, leaf string, other string"
    )
    if keys.agg(F.max("copies")).first()[0] in (None, 1):
        return stage(ranked.drop("copies"), "slots")
    ranked = stage(ranked, "slots")
    single = ranked.filter(F.col("copies") == 1).drop("copies")
    first = ranked.filter(F.col("copies") > 1).select("grp", "key", F.col("slot").alias("first"))
    # Equal rows are one until the last step; the others of a key are numbered in 256 parts by their leaves.
    same = null_safe_join(leaves, first, ["grp", "key"]).groupBy("grp", "key", "first", "leaf", "other").agg(F.count("*").alias("n"))
    same = same.withColumn("part", F.substring("leaf", 1, 2))
    own, by = Window.partitionBy("grp", "key", "part").orderBy("leaf"), Window.partitionBy("grp", "key").orderBy("part")
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = same.groupBy("grp", "key", "part").agg(F.sum("n").alias("n")).withColumn("begin", before)
    inside = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = null_safe_join(same.withColumn("inside", inside), parts.select("grp", "key", "part", "begin"), ["grp", "key", "part"])
    at = F.col("first") + F.col("begin") + F.col("inside")
    several = numbered.select("grp", "key", F.explode(F.sequence(at, at + F.col("n") - 1)).alias("slot"), "leaf", "other")
    return stage(single.unionByName(several.select("grp", "key", "slot", "leaf", "other")), "slots")


# Trees -------------------------------------------------------------------------------------------


def digest(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def levels_of(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """A block's levels, its nodes first: down to one node if the block is all there is, else ``DEPTH`` of them."""
    levels = [nodes]
    alone = total <= 1 << BLOCK_BITS
    while len(levels[-1]) > 1 if alone else len(levels) <= DEPTH:
        last = levels[-1]
        levels.append([digest(b"".join(last[i:i + FAN])) for i in range(0, len(last), FAN)])
    return levels


def siblings(nodes: list[bytes]) -> list[tuple[bytes, bytes]]:
    """What stands left and right of each node in its run."""
    out = []
    for i in range(0, len(nodes), FAN):
        run = nodes[i:i + FAN]
        out += [(b"".join(run[:j]), b"".join(run[j + 1:])) for j in range(len(run))]
    return out


def folded(node: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a node and what stands beside it on its way up give."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    table = table.take(np.argsort(table["slot"].to_numpy()))
    return table, [d.encode() for d in table["leaf"].to_pylist()]


NODES = "grp long, slot long, leaf string, total long"


def _reduced(table: pa.Table) -> pa.Table:
    _, nodes = _ordered(table)
    total = table["total"][0].as_py()
    return pa.table({
        "grp": table["grp"].slice(0, 1), "slot": pa.array([table["slot"][0].as_py() >> BLOCK_BITS], pa.int64()),
        "leaf": [levels_of(nodes, total)[-1][0].decode()], "total": pa.array([-(-total >> BLOCK_BITS)], pa.int64()),
    })


def tree(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """Tables of nodes from the leaves up, each holding a node for every 4096 of the one before."""
    rounds = [nodes]
    while largest > 1:
        blocks = rounds[-1].select("grp", "slot", "leaf", "total").groupBy("grp", F.shiftright("slot", BLOCK_BITS).alias("block"))
        rounds.append(stage(blocks.applyInArrow(_reduced, NODES), "nodes"))
        largest = -(-largest >> BLOCK_BITS)
    return rounds


PATH = "array<struct<left:string,right:string>>"
PATHS = f"grp long, slot long, path {PATH}, subroot string, root string"


def _paths(table: pa.Table, above: pa.Table) -> tuple[pa.Table, list[bytes], list[list[tuple[bytes, bytes]]], list[list[tuple[bytes, bytes]]], list[tuple[bytes, bytes]]]:
    """A block in order of slots: its nodes, its levels' siblings, and the path above it."""
    table, nodes = _ordered(table)
    beside = [siblings(level) for level in levels_of(nodes, table["total"][0].as_py())[:-1]]
    upper = [(p["left"].encode(), p["right"].encode()) for p in above["path"][0].as_py()]
    return table, nodes, beside, upper


def _own_path(i: int, beside: list[list[tuple[bytes, bytes]]]) -> list[tuple[bytes, bytes]]:
    return [level[i // FAN**j] for j, level in enumerate(beside)]


def _text(path: list[tuple[bytes, bytes]]) -> list[dict[str, str]]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def _handed_down(table: pa.Table, above: pa.Table) -> pa.Table:
    table, nodes, beside, upper = _paths(table, above)
    paths = [_text(_own_path(i, beside) + upper) for i in range(len(nodes))]
    n = len(nodes)
    return pa.table({
        "grp": table["grp"], "slot": table["slot"],
        "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
        "subroot": pa.array(above["subroot"].to_pylist() * n, pa.string()), "root": pa.array(above["root"].to_pylist() * n, pa.string()),
    })


PROOFS = f"grp long, slot long, key long, leaf string, other string, path {PATH}, subroot string, root string"
DIGESTS = "grp long, slot long, key long, leaf string, proof_sha256 string, folded_root string, verified boolean, subroot string, root string"


def _proofs(table: pa.Table, above: pa.Table) -> pa.Table:
    down = _handed_down(table, above)
    table, _ = _ordered(table)
    return pa.table({c: table[c] if c in ("key", "leaf", "other") else down[c] for c in ("grp", "slot", "key", "leaf", "other", "path", "subroot", "root")})


def _digests(table: pa.Table, above: pa.Table) -> pa.Table:
    """Each leaf's proof as a digest, and the root that its other leaf folds to."""
    table, nodes, beside, upper = _paths(table, above)
    others = [d.encode() for d in table["other"].to_pylist()]
    root, rest = above["root"][0].as_py(), b"".join(a + b for a, b in upper)
    # What follows in the proofs of all nodes below one.
    tails = [rest]
    for level in reversed(beside):
        tails = [a + b + tails[i // FAN] for i, (a, b) in enumerate(level)]
    back = [folded(d, _own_path(i, beside) + upper).decode() for i, d in enumerate(others)]
    n = len(nodes)
    return pa.table({
        "grp": table["grp"], "slot": table["slot"], "key": table["key"], "leaf": table["leaf"],
        "proof_sha256": [digest(t).decode() for t in tails], "folded_root": back, "verified": [b == root for b in back],
        "subroot": pa.array(above["subroot"].to_pylist() * n, pa.string()), "root": pa.array([root] * n, pa.string()),
    })


def descend(rounds: list[DataFrame], top: DataFrame, last, schema: str) -> DataFrame:
    """From the paths of the top nodes down; ``last`` makes the rows of the leaves."""
    above = top
    for i, nodes in reversed([*enumerate(rounds)][:-1] or [(0, rounds[0])]):
        make, shape = (_handed_down, PATHS) if i else (last, schema)
        # A tree of one round is nodes that are blocks of their own; what lies above never shares columns with it.
        block = (F.col("slot") if len(rounds) == 1 else F.shiftright("slot", BLOCK_BITS)).alias("block")
        heads = above.select(F.col("grp").alias("of"), F.col("slot").alias("block"), "path", "subroot", "root")
        above = nodes.groupBy("grp", block).cogroup(heads.groupBy("of", "block")).applyInArrow(make, shape)
    return above


def numbered_groups(leaves: DataFrame) -> DataFrame:
    """``name``, ``total`` and ``grp``, the place of each group in the order of names, null first.

    Names are sorted in ranges; a row's place is its place in its range after the rows of all ranges before.
    """
    counted = leaves.groupBy("name").agg(F.count("*").alias("total"))
    ordered = stage(counted.orderBy("name").withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), "groups")
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # one per range
    bases = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    base = F.lit(0).cast("bigint")
    if sizes:
        base = F.create_map(*[F.lit(x) for (part, _), b in zip(sizes, bases) for x in (part, int(b))])[F.col("part")].cast("bigint")
    return ordered.select("name", "total", (base + F.col("id").bitwiseAND((1 << 33) - 1)).alias("grp"))


def manifest(
    docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    changed: Mapping[str, Column] | None = None, proofs: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``name`` (its group), ``key``, ``slot``, ``leaf``, ``subroot``, ``root``, and its proof.

    ``changed`` gives other values of some fields; the leaf made with them is folded along the original path.
    The proof is a digest (``proof_sha256``, ``folded_root``, ``verified``), or with ``proofs`` the whole
    ``path`` of left and right siblings and the ``other`` leaf, for ``folded``.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    leaves = stage(
        docs.select(
            F.col(group).cast("string").alias("name"), F.col(key).cast("bigint").alias("key"), leaf([*values.values()]).alias("leaf"),
            leaf([*(values | dict(changed or {})).values()]).alias("other"),
        ),
        "leaves",
    )
    groups = stage(numbered_groups(leaves), "groups")
    n_groups, largest = groups.agg(F.count("*"), F.coalesce(F.max("total"), F.lit(0))).first()
    sizes = groups.select("grp", "total")
    slots = with_slots(null_safe_join(leaves, groups.select("name", "grp"), ["name"]))
    rounds = tree(slots.join(sizes, "grp"), largest)
    subroots = rounds[-1].select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("slot"), "leaf", F.lit(n_groups).cast("bigint").alias("total"))
    trunk = tree(subroots, n_groups)
    no_path = F.array().cast(PATH).alias("path")
    root = trunk[-1].select("grp", "slot", no_path, F.col("leaf").alias("subroot"), F.col("leaf").alias("root"))
    branches = descend(trunk, root, _handed_down, PATHS).withColumnRenamed("slot", "of").drop("grp", "subroot")
    tops = branches.join(subroots.select(F.col("slot").alias("of"), F.col("leaf").alias("subroot")), "of")
    tops = stage(tops.select(F.col("of").alias("grp"), F.lit(0).cast("bigint").alias("slot"), "path", "subroot", "root"), "branches")
    proved = descend(rounds, tops, *((_proofs, PROOFS) if proofs else (_digests, DIGESTS)))
    return proved.join(groups.select("grp", "name"), "grp").drop("grp")

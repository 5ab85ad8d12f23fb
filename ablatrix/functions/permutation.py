"""Seeded permutations of 0 to n - 1 by arithmetic: a place's rank without sorting or counting.

A position is two digits to bases a and b of about the root of n. In each round one digit is shifted by a keyed
function of the other, which can be undone, so every round permutes 0 to a * b - 1. The few results beyond
n - 1 go round again until they fall inside (cycle walking). The same integers come out of NumPy and of Spark.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

from .text import let

ROUNDS = 6
#: A prime whose squares fit 62 bits.
PRIME = 2**31 - 1
#: Walks tried by the expression; each falls outside with a chance of about one in the root of n.
WALKS = 24


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    digests = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(ROUNDS)]
    return [tuple(int.from_bytes(d[j:j + 8]) % PRIME for j in (0, 8, 16)) for d in digests]


def bases(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _once(x: np.ndarray, n: int, keys: list[tuple[int, int, int]]) -> np.ndarray:
    a, b = bases(n)
    u, v, base, other = x // b, x % b, a, b
    for m, c, d in keys:
        t = (v * m + c) % PRIME
        t = (t * t + d) % PRIME
        u, v, base, other = v, (u + t) % base, other, base
    return u * b + v


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Ranks of the positions ``x``, all below ``n``."""
    keys = round_keys(seed)
    out = _once(np.asarray(x, np.int64), n, keys)
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = _once(out[far], n, keys)
    return out


def permuted_column(x: Column, n: int, seed: int) -> Column:
    """The rank of position ``x`` as a built-in expression; null outside of 0 to n - 1."""
    a, b = bases(n)
    keys = F.array(*[F.struct(*[F.lit(k).cast("bigint").alias(c) for k, c in zip(ks, "mcd")]) for ks in round_keys(seed)])

    def turn(s: Column, k: Column) -> Column:
        t = (s["v"] * k["m"] + k["c"]) % PRIME
        t = let(t, lambda y: (y * y + k["d"]) % PRIME)
        return F.struct(
            s["v"].alias("u"), ((s["u"] + t) % s["base"]).alias("v"), s["other"].alias("base"), s["base"].alias("other")
        )

    def quotient(y: Column) -> Column:
        # Whole-number division; a quotient of doubles would be off for large positions.
        return F.call_function("div", y, F.lit(b).cast("bigint"))

    def once(y: Column) -> Column:
        start = F.struct(
            quotient(y).alias("u"),
            (y % b).cast("bigint").alias("v"), F.lit(a).cast("bigint").alias("base"), F.lit(b).cast("bigint").alias("other"),
        )
        return F.aggregate(keys, start, turn, lambda s: s["u"] * b + s["v"])

    def walk(y: Column, _: Column) -> Column:
        return F.when(y >= n, once(y)).otherwise(y)

    position = x.cast("bigint")
    first = F.when(position.between(0, n - 1), once(position))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, walk)
    return F.when(found < n, found).when(found.isNotNull(), F.raise_error(F.lit("a rank was not found")).cast("bigint"))

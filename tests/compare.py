"""Comparing a catalog query with its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None and not isinstance(v, float) else repr(v)) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and the SQL's result; empty when they agree."""
    got = df.toArrow()
    con.execute(sql)
    want_names = [d[0] for d in con.description]
    want = con.fetchall()
    names = sorted(got.column_names)
    if names != sorted(want_names):
        return [f"columns {names} != {sorted(want_names)}"]
    left = [tuple(_plain(r[n]) for n in names) for r in got.to_pylist()]
    order = [want_names.index(n) for n in names]
    right = [tuple(_plain(r[i]) for i in order) for r in want]
    if len(left) != len(right):
        return [f"rows {len(left)} != {len(right)}"]
    left, right = sorted(left, key=_key), sorted(right, key=_key)
    return [f"{a} != {b}" for a, b in zip(left, right) if a != b][:3]

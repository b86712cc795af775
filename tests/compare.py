"""Rows of a DataFrame against rows of a DuckDB query, without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(folder).iterdir():
        c.execute(f"create view {f.name.split('.')[0]} as select * from '{f}'")
    return c


def same_rows(df, sql: str, folder: str) -> None:
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    result = views(folder).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(dict(zip(names, r))[c]) for c in columns)) for r in result.fetchall())
    assert got == want

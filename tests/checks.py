"""Compares a registered query with its SQL, row by row."""

from __future__ import annotations

import decimal
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("float", repr(v))
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the difference."""
    got_cols, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {sorted(set(got_cols) ^ set(want_cols))}"
    if sum(got.values()) != sum(want.values()):
        return f"row counts differ: {sum(got.values())} vs {sum(want.values())}"
    if got == want:
        return None if sum(got.values()) else "both empty"
    extra, missing = got - want, want - got
    key = lambda t: tuple(str(x) for x in t)
    a, b = sorted(extra, key=key)[:2], sorted(missing, key=key)[:2]
    detail = ""
    if a and b:
        detail = "; ".join(f"{c}: {x} | {y}" for c, x, y in zip(got_cols, a[0], b[0], strict=True) if x != y)
    return f"{sum(extra.values())} rows differ; first: {detail[:700]}"

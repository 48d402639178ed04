"""Run a query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """An empty string, or how the two differ."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows(cols, res.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} and {sorted(cols)}"
    if got == want:
        return ""
    diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
    return f"{name}: {len(got)} and {len(want)} rows; {str(diff)[:400]}"

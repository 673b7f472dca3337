"""Runs a query and its SQL side by side and compares rows without regard to order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if hasattr(x, "asDict"):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(_plain(y) for y in x.values())
    return x


def compare(df, sql: str, sf_dir: str) -> tuple[int, list]:
    """Rows of the query; the first differences (empty: equal)."""
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = duck(sf_dir).execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return len(mine), [("columns", names, sorted(cols))]
    at = [cols.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(mine) != len(theirs):
        return len(mine), [("rows", len(mine), len(theirs))]
    return len(mine), [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b][:3]

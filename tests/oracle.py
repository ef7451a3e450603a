"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    return cols, sorted(([plain(r[names.index(c)]) for c in cols] for r in cur.fetchall()), key=repr)

"""Compares a query's rows with its oracle SQL on the same tables."""

import glob
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(src):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{src}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)

"""Compares a query's rows with its SQL on the same tables."""

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def compare(con, sql, df, path):
    df.write.mode("overwrite").parquet(path)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    got = con.execute(f"SELECT * FROM '{path}/*.parquet'")
    mine = [d[0] for d in got.description]
    assert sorted(mine) == sorted(names)
    order = sorted(names)
    a = Counter(repr([plain(r[names.index(c)]) for c in order]) for r in rows)
    b = Counter(repr([plain(r[mine.index(c)]) for c in order]) for r in got.fetchall())
    assert a == b, (list((a - b))[:3], list((b - a))[:3])

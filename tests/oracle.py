"""Compares a query with its SQL on the same tables."""

import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(_plain(r[i])) for i in order) for r in rows))


def check(spark, query, sql, folder):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(folder).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want

"""Runs a query and its DuckDB twin on one folder and compares rows regardless of order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def same(spark, folder, query, sql):
    df = query(spark, folder)
    cursor = connect(folder).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert ours == theirs

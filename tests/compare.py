"""Rows of a query beside rows of its SQL, in any order."""

import datetime
import decimal
import math
import os

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def tables(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(folder):
        path = os.path.join(folder, f)
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def sql_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())

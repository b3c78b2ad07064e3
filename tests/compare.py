"""Compares a query's rows with those of its SQL."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, text):
    r = con.sql(text)
    names = list(r.columns)
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)

"""Rows of a query and of its SQL, made comparable."""

import decimal
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(folder):
        path = f"{folder}/{file}"
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else 0.0 if abs(x) < 1e-12 else float(f"{x:.9g}")
    if isinstance(x, list | tuple):
        return str([plain(y) for y in x])
    return x


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)


def rows_of_sql(con, sql):
    found = con.sql(sql)
    order = [found.columns.index(n) for n in sorted(found.columns)]
    return sorted((tuple(plain(r[k]) for k in order) for r in found.fetchall()), key=str), sorted(found.columns)

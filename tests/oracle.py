"""Runs a query and its SQL equivalent over the same tables and compares their rows without order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def assert_same(df, connection, sql):
    got = rows_of(df.columns, df.collect())
    rel = connection.execute(sql)
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, rel.fetchall())

"""Comparison of a Spark result with DuckDB's."""

import numbers
import os
from collections import Counter

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, numbers.Number) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def same(df, rel):
    assert sorted(df.columns) == sorted(rel.columns)
    got, want = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

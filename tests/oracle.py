"""Compares a query with its SQL in DuckDB, as rows without order."""

import math
import os

import duckdb

_OPEN = {}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v) if isinstance(v, float) else str(v)


def connection(sf):
    if sf not in _OPEN:
        _OPEN[sf] = duckdb.connect()
        for f in os.listdir(sf):
            _OPEN[sf].sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return _OPEN[sf]


def check(spark, sf, query, sql):
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    want = connection(sf).sql(sql)
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())

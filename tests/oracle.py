"""Runs a query and its SQL side by side over one folder of test data."""

import math
import os

import duckdb

DATA = "/root/testdata"


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return str(v)


def compare(spark, con, build, sql, sf_dir):
    df = build(spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())
    assert sorted(tuple(map(plain, row)) for row in df.select(columns).collect()) == expected

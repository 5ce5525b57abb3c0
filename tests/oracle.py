"""Comparison of a query with its SQL in DuckDB, as multisets of rows with columns in order of their names."""

import decimal
import glob
import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(df, sql: str, con) -> None:
    r = con.execute(sql)
    columns, expected = [d[0] for d in r.description], r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(columns, expected)

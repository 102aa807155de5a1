"""Runs a query and its SQL and compares the rows, whatever their order."""

from __future__ import annotations

import os

import duckdb


def plain(v: object) -> object:
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql: str, folder: str) -> int:
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    df = query(spark, folder)
    columns = sorted(df.columns)
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in expected.fetchall())
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert ours == theirs
    return len(ours)

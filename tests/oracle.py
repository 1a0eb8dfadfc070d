"""Comparison of a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    found = duckdb.connect()
    found.execute("SET TimeZone='UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return found


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=repr)


def compare(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want

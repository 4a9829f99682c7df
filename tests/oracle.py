"""Compares a query with its SQL in DuckDB: columns by name, rows in any order, doubles to nine digits."""

from __future__ import annotations

import decimal
import math
from pathlib import Path


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=repr)


def connection(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def check(spark, folder: str, query, statement: str) -> None:
    df = query(spark, folder)
    got = rows(df.columns, df.collect())
    answer = connection(folder).sql(statement)
    assert sorted(df.columns) == sorted(answer.columns)
    assert got == rows(answer.columns, answer.fetchall())

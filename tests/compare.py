"""Compares a Spark result with DuckDB's result of the same query, whatever the order of rows and columns."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str | bytes):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    return round(float(x), 6) + 0.0


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def assert_same(df, sf_dir: str, sql: str) -> None:
    names, rows = spark_rows(df)
    want_names, want = duck_rows(sf_dir, sql)
    assert names == want_names, (names, want_names)
    assert sum(rows.values()) == sum(want.values()), (sum(rows.values()), sum(want.values()))
    assert rows == want, (list((rows - want))[:3], list((want - rows))[:3])

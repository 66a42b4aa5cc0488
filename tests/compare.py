"""Comparing a DataFrame with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)
    return "nan" if math.isnan(v) else f"{round(float(v), 6):.6f}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def check(df, con, sql: str) -> None:
    got = con.execute(sql)
    names, expected = [x[0] for x in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, expected)

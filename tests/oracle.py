"""Compare a query with its DuckDB twin: schema by name, row count, values in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        import datetime as dt

        return x.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = views(sf_dir).execute(sql)
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    assert sorted(columns) == sorted(df.columns), (name, columns, df.columns)
    assert len(got) == len(want), (name, len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (name, a, b)

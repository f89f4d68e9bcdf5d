"""Rows of a query beside those of its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 4) + 0.0
    if hasattr(x, "as_tuple"):
        return round(float(x), 4) + 0.0
    return x


def rows(columns, values) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k].lower())
    return sorted([tuple(_cell(v[k]) for k in order) for v in values], key=lambda r: [(x is None, str(x)) for x in r])


def differences(spark_df, con, sql: str) -> str:
    """Empty where both give the same rows."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(c.lower() for c in names) != sorted(c.lower() for c in spark_df.columns):
        return f"columns {names} {spark_df.columns}"
    if len(want) != len(got):
        return f"rows: SQL {len(want)}, Spark {len(got)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if any(x != y and not (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-4 * max(1, abs(x))) for x, y in zip(a, b, strict=True))]
    return f"{len(bad)} rows differ, such as {bad[:2]}" if bad else ""

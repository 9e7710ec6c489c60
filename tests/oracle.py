"""Runs a Spark query and its SQL twin and compares them value by value."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return [_cell(x) for x in v]
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if type(v).__name__.startswith(("int", "uint")):
        return int(v)
    if type(v).__name__ in ("float64", "float32"):
        return None if math.isnan(v) else repr(float(v) + 0.0)
    return str(v)


def rows(names: list[str], data) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([_cell(r[i]) for i in order]) for r in data)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}; first {a[:2]} vs {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ ({sorted(names)}): {bad[:3]}"
    return None

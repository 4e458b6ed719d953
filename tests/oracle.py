"""Runs queries against their SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(DATA, sf, f"{t}.parquet")
        where = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{where}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 7)
    if hasattr(x, "item"):
        return _cell(x.item())
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in values), key=repr)


def differences(frame, con, sql: str, most: int = 4) -> list[str]:
    """What the two results don't share, as lines; empty if they are equal."""
    got = [tuple(r) for r in frame.collect()]
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} and {sorted(names)}"]
    a, b = rows(frame.columns, got), rows(names, want)
    if len(a) != len(b):
        return [f"{len(a)} and {len(b)} rows", str(a[:1]), str(b[:1])]
    return [f"{x} | {y}" for x, y in zip(a, b) if x != y][:most]

"""Compares a query with its SQL on DuckDB: row counts, columns by name, and values without regard to order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return float(v) if type(v).__name__ == "Decimal" else v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty string where both agree, else what differs."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    found = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if found == want:
        return ""
    extra, missing = list((found - want).elements()), list((want - found).elements())
    return f"{sum(found.values())} rows, {sum(want.values())} wanted; {len(extra)} differ: {sorted(map(str, extra))[:3]} and {sorted(map(str, missing))[:3]} ({names})"

"""Holds a query against its SQL on the same tables: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return "nan" if isinstance(x, float) and math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)[:19]
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return str(x)


def duck(sf_dir: str, tables) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differ(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    got = [tuple(value(r[c]) for c in names) for r in df.collect()]
    out = con.sql(sql)
    if sorted(out.columns) != names:
        return f"columns {names} {sorted(out.columns)}"
    at = [out.columns.index(c) for c in names]
    want = [tuple(value(r[k]) for k in at) for r in out.fetchall()]
    if Counter(got) != Counter(want):
        a, b = Counter(got), Counter(want)
        return f"{len(got)} rows, {len(want)} in SQL; only here {list((a - b).elements())[:2]}; only in SQL {list((b - a).elements())[:2]}"
    return None if got else "no rows"

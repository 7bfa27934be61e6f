"""Runs a registered query and its SQL counterpart and compares the rows."""

from __future__ import annotations

import math
import os
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, str):
        return v
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    if math.isnan(f):
        return "NaN"
    return f + 0.0


def order(row):
    return tuple((x is None, str(type(x)), x) if not isinstance(x, tuple) else (False, "tuple", str(x)) for x in row)


def rows_of(names: list[str], rows) -> list[tuple]:
    index = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in index) for r in rows), key=order)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    sql_names = [d[0] for d in rel.description]
    expected = rows_of(sql_names, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(sql_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(sql_names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows vs {len(expected)}"
    bad = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}" if bad else None

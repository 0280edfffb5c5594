"""Runs queries beside their DuckDB SQL and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

from lodestone.sources.tables import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(df, con, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    table = con.execute(sql)
    names = [c[0] for c in table.description]
    want = rows_of(names, table.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"{len(got)} and {len(want)} rows; first differences {odd}"

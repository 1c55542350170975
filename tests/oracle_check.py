"""Compare a registered query with its SQL in DuckDB: same columns, same kinds of type, same rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """NULL when both agree, else what differs first."""
    result = con.execute(sql)
    sql_columns = [d[0] for d in result.description]
    want = _sorted_rows(sql_columns, result.fetchall())
    got = _sorted_rows(df.columns, df.collect())
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; {next((p for p in zip(got, want) if p[0] != p[1]), None)}"
    for mine, theirs in zip(got, want):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{sorted(df.columns)}: {mine} != {theirs}"
    return None

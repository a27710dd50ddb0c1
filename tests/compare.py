"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        if Path(f"{sf_dir}/{table}.parquet").exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(frame, con, sql: str, shown: int = 3) -> str | None:
    """None if equal, else what differs."""
    result = con.execute(sql)
    expected_columns = [c[0] for c in result.description]
    if sorted(expected_columns) != sorted(frame.columns):
        return f"columns: {sorted(frame.columns)} != {sorted(expected_columns)}"
    expected = rows_of(expected_columns, result.fetchall())
    actual = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if len(actual) != len(expected):
        extra = [r for r in actual if r not in expected][:shown] if len(actual) < 5000 else []
        return f"row count: {len(actual)} != {len(expected)}; e.g. {extra}"
    wrong = [(a, e) for a, e in zip(actual, expected, strict=True) if a != e]
    return f"{len(wrong)} of {len(actual)} rows differ, e.g. {wrong[:shown]}" if wrong else None

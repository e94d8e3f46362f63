"""Compare a registered query with its SQL, the way a reader would: sorted rows, same names."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (decimal.Decimal, datetime.datetime, datetime.date)):
        return str(value)
    return repr(value)


def kind(value) -> str:
    return type(value).__name__


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> str | None:
    """None if equal, else what differs first."""
    got_columns = list(frame.columns)
    got = [tuple(r) for r in frame.collect()]
    cursor = connection.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    for left, right in zip(a, b):
        if left != right:
            return f"{left} != {right}"
    return None

"""Row-for-row comparison of a Spark result with its SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def kind(value):
    return type(plain(value)).__name__


def differences(df, con, sql: str, show: int = 3) -> str:
    """Empty text if both results agree in columns, value types and rows."""
    result = con.execute(sql)
    expected_columns = [d[0] for d in result.description]
    expected_rows = result.fetchall()
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    expected = canonical(expected_columns, expected_rows)
    if repr(actual) == repr(expected):
        return ""
    extra = set(map(repr, actual)) - set(map(repr, expected))
    missing = set(map(repr, expected)) - set(map(repr, actual))
    return (f"rows {len(actual)} vs {len(expected)}; only Spark {len(extra)}: {sorted(extra)[:show]}; "
            f"only SQL {len(missing)}: {sorted(missing)[:show]}")

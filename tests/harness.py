"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(value):
    """A value in a form that both engines share."""
    import datetime
    import decimal

    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], data) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(df, db: duckdb.DuckDBPyConnection, sql: str) -> None:
    """Assert that frame and SQL have the same columns and rows, order aside."""
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns), (columns, df.columns)
    want, got = rows(columns, found.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(want) == len(got), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b, (a, b)

"""Run a query and its SQL counterpart and compare the rows."""

from __future__ import annotations

import duckdb

from clusterlens.checks.base import TABLES


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _key(row):
    return tuple((value is not None, str(type(value)), value if not isinstance(value, (list, dict)) else repr(value)) for value in row)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=_key)


def compare(spark, name: str, function, sql: str, folder: str, connection) -> str | None:
    """None if equal, else what differs."""
    frame = function(spark, folder)
    left_names, left = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    right_names, right = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return f"{name}: columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"{name}: {len(left)} rows != {len(right)} rows; first spark {left[:1]}, first sql {right[:1]}"
    for a, b in zip(left, right):
        if a != b:
            return f"{name}: spark {a} != sql {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"{name}: types {a} {b}"
    return None if left else f"{name}: no rows"

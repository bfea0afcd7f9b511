"""Runs a registered query in Spark and its checking SQL side by side."""

from __future__ import annotations

import math

import duckdb

from netloom.plans.views import BASE_TABLES


def duck(sf_dir: str):
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, sql: str, connection) -> str | None:
    """None when equal, else what differs."""
    spark_rows = rows(df.columns, df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    duck_rows = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} / {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b:
            return f"first difference:\n  spark {a}\n  check {b}"[:1500]
    return None

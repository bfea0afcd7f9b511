"""Collects the registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name``, with its checking SQL if it has one."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


def stamp(ts) -> Column:
    """Timestamp as text, written the same way by both engines."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def duck_stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def joined(array) -> Column:
    """Array of text as one text, parts separated by a bar."""
    return F.array_join(array, "|")


def at(text: str) -> Column:
    """Literal timestamp without zone."""
    return F.to_timestamp_ntz(F.lit(text))

"""Registration of queries and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a query; ``sql`` is the equivalent DuckDB statement."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            STATEMENTS[name] = sql if isinstance(sql, str) else sql()
        return fn

    return add

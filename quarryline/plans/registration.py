"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def plan(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name; ``sql`` is the same over the Parquet tables."""

    def register(query: Query) -> Query:
        name = query.__name__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return register

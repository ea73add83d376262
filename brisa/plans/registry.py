"""Named queries over the driver tables, the SQL they must equal, and the
operators of the survey each one shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(covers: str, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise KeyError(f"query {key} is registered twice")
        QUERIES[key] = fn
        COVERS[key] = tuple(covers.split())
        if sql:
            ORACLE[key] = sql
        return fn
    return add

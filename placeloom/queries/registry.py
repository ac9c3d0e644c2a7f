"""name -> query(spark, sf_dir), and name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "flagship_alias_rrf"


def query(name: str, sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add

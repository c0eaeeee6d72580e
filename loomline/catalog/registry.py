"""Name -> (Spark query, oracle SQL) registries behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]


def registry() -> tuple[Queries, dict[str, str], Callable]:
    """An empty registry: its queries, their SQL, and the decorator that fills both."""
    queries: Queries = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def register(fn):
            if name in queries:
                raise ValueError(f"query {name!r} is registered twice")
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return register

    return queries, oracles, query


QUERIES, ORACLES, query = registry()

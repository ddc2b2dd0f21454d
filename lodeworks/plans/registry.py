"""The library's named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a role view set as a query named like it."""

    def register(f):
        from lodeworks.sources.roles import Roles

        QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from lodeworks.plans import catalogue_queries, state_queries, text_queries  # noqa: F401


_load()

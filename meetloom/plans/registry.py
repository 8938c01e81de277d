"""Collects queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *views: str, oracle: str | None = None):
    """Registers a function of the named domain tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, v) for v in views])

        run.__name__ = name
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = with_views(oracle)
        return f

    return register

"""Query registry: every inventory operator registers a Spark callable
``(spark, sf_dir) -> DataFrame`` and, when SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.oracle_fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn`` under ``name``; ``oracle`` is DuckDB SQL over the test tables and
    the named fixture views (added as CTEs)."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = with_fixtures(oracle, *fixtures)
        return fn

    return deco

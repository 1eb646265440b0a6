"""Registry of named queries: a Spark builder and, where SQL can express
it, an independent DuckDB SQL statement of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its keys register."""
    from . import (q_domain, q_joins_aggs, q_model, q_models, q_reports, q_scalar,  # noqa: F401
                   q_sources, q_windows)

"""The named queries over the driver's tables, each with the SQL that checks it.

A module of queries registers with ``@query(name, sql)``; ``sql`` is left out where SQL can't express the result.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("queries_evaluation", "queries_estimators", "queries_losses", "queries_correction", "queries_batch", "queries_metrics", "queries_text", "queries_retrieval", "queries_placement", "queries_streams", "queries_datasets", "queries_variants")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tidemill.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

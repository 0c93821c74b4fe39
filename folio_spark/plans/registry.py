"""All registered queries over the given tables, with the SQL that they are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("temporal", "names", "texts", "retrieval", "citation", "rules", "quality", "logs")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, and the DuckDB SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"folio_spark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

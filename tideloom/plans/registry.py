"""Name -> query, and name -> SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql:
            _SQL[name] = sql
        return query

    return keep


#: Modules whose import registers queries.
_MODULES = ("preparation", "graphs", "ranking", "language", "experiments", "evaluation", "temporal", "retrieval", "candidates", "attention", "sketches")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tideloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL

"""All queries of the engine, by name, each with the SQL it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query; sql is what DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        assert key not in _QUERIES, key
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    from . import aggregates, audits, edits, intervals, media, numbers, phrases, records, repairs, reviews, rules, sequences, texts, transcripts  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

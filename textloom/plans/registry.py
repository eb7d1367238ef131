"""Registered queries of the core operators with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
MODULES = ("corpus", "conversation", "retrieval", "tokenizer", "evaluation", "tensors", "io", "relations")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that DuckDB runs on the same tables."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = f
        if sql is not None:
            _oracles[key] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"textloom.plans.{name}")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid retrieval from chunking to the answer prompt."""
    return queries()["r8_answer_prompt"](spark, sf)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)

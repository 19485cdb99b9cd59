"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "scalars",
    "offers",
    "keyed",
    "activity",
    "logs",
    "alerts",
    "vectors",
    "documents",
    "inference",
    "pages",
    "catalog",
    "sources",
    "streams",
    "stored",
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``; ``sql`` is the same result in ANSI SQL."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def load() -> None:
    """Import every module that registers queries."""
    from importlib import import_module

    for module in MODULES:
        import_module(f"tallyloom.queries.{module}")

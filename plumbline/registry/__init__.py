"""Registered queries: every operator on the driver's tables, each next to the
SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_MODULES = (
    "catalog", "profiling", "nulls", "duplicates", "conformance", "drift", "relational",
    "repairs", "injection", "scoring", "history", "querylog", "audits", "own_reports", "stored",
)


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with its SQL twin."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql.strip()
        return function

    return add


def load_all() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")

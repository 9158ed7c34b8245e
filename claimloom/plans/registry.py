"""Collects the queries of the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Modules of this package that register queries.
MODULES: tuple[str, ...] = ("relational", "text", "aggregates", "scoring", "clusters", "entities", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, and its SQL."""

    def add(f: Query) -> Query:
        if name in _QUERIES and _QUERIES[name] is not f:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"claimloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)

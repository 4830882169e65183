"""Register of all queries with their SQL, filled by the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = [
    "quire.operators.scans", "quire.sources.rendering", "quire.operators.filters", "quire.operators.joins", "quire.operators.aggregates", "quire.operators.ordering",
    "quire.operators.scalars", "quire.operators.search", "quire.operators.ingest", "quire.operators.mutations", "quire.plans.stages",
    "quire.plans.translation", "quire.streaming.ingest", "quire.operators.baselines",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(m)

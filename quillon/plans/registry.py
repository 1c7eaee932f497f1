"""Registry of the library's queries and their DuckDB oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "agg10_grouping_sets"
_MODULES = ("relational", "statistics", "sequence", "inference", "comparisons", "regressions", "connectors", "reductions")


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load_all() -> None:
    """Imports every module of queries."""
    for name in _MODULES:
        importlib.import_module(f"quillon.plans.{name}")

"""All registered queries of the engine and their equivalents in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["filtering", "joining", "aggregating", "ranking", "scoring", "functions", "maintaining", "answering", "evaluating", "streams", "tracks", "retrieving", "indexing", "vocabularies", "dialogs"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with SQL that returns the same rows where there is such."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


for _module in MODULES:
    importlib.import_module(f"tidepool.plans.{_module}")

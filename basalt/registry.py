"""The queries of the engine, each beside the SQL that checks it.

A query module calls ``@query(name, oracle)`` on a function of a session and a
table folder, so that a query and its oracle cannot drift apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from basalt.sources.tables import sql

Query = Callable[[SparkSession, str], DataFrame]

MODULES = [
    "relational",
    "aggregation",
    "windows",
    "subqueries",
    "scalars",
    "dates",
    "documents",
    "search",
    "vectors",
    "changes",
    "extras",
]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return register


def shared(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL over ``{table}`` names that both engines run (or ``oracle`` where dialects differ)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, sf_dir, text)

    query(name, re.sub(r"{(\w+)}", r"\1", oracle or text))(run)


def _load() -> None:
    for module in MODULES:
        import_module(f"basalt.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)

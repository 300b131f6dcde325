"""Named queries of the domain operators and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "flagship_disaggregate"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    """Imports the modules that register queries."""
    from . import allocation, checks, cleaners, cleaning, comparison, external, files, frames, learning, matching, nodal, nodes, proportional, scenarios, statistics, stochastic, testing, weights  # noqa: F401

"""Queries over the test tables, one per operator, each with an SQL twin where SQL can say it.

A query takes (spark, folder of Parquet tables) and returns a DataFrame.  The twin is SQL
text over the same tables, written independently of the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mergelight.plans.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, if given, its SQL twin."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return function

    return register

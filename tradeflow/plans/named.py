"""The table of named queries: a function over a Domain and, where SQL expresses it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tradeflow.sources.trades import Domain

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: str = "") -> Callable:
    """Registers f(Domain) under its name; prelude holds the SQL's common tables."""

    def add(f: Callable[[Domain], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Domain(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {prelude} {sql}" if prelude else sql
        return f

    return add

"""Named queries over the driver's tables, with equivalent SQL where it can be written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: SQL that is too slow for whole tables; tests run it on the smallest ones.
SMALL_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, small_sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        if small_sql:
            SMALL_ORACLES[name] = small_sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _ORACLES

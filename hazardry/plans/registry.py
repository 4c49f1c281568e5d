"""Registry of the engine's queries and of the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def put(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            _ORACLES[name] = sql
        return function

    return put


def queries() -> dict[str, Query]:
    """All registered queries."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    return dict(_ORACLES)


def _load() -> None:
    """Import the modules that register queries."""
    from hazardry.plans import queries_evaluation, queries_functions, queries_scoring  # noqa: F401


_load()

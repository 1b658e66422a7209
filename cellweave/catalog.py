"""Registry of the spatial queries and their SQL twins.

A query is registered with :func:`register`. Its SQL body may use the fixture views ``f_cells``, ``f_reads``, ``f_counts`` and
``f_polygons``; a body that starts with WITH has its own common tables after them.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cellweave.plans.fixtures import SQL_VIEWS

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("read_queries", "matrix_queries", "space_queries", "score_queries", "pipeline")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: enter a query, and its SQL twin where there is one."""

    def enter(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            body = sql.strip()
            head = f"WITH {SQL_VIEWS}"
            _ORACLES[name] = f"{head}, {body[4:].lstrip()}" if body.upper().startswith("WITH") else f"{head} {body}"
        return query

    return enter


def _load() -> None:
    for module in _MODULES:
        import_module(f"cellweave.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES

"""Registry of the engine's queries and of their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under a name, with its oracle SQL where there is one."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if oracle is not None:
            ORACLE[name] = oracle
        return query

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    from cadenza.plans import analytics, catalog, checks, core, evaluation, names, pages, parsing, profiles, records, scoring, seats, selection  # noqa: F401


_load()

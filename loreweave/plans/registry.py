"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import FX_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql may use the fixture views and goes on with more CTEs or a SELECT."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLES[f.__name__] = f"WITH {FX_SQL}{', ' if not body.upper().startswith('SELECT') else ''}{body}"
        return f

    return add


from . import catalog  # noqa: E402,F401

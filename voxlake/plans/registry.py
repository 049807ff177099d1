"""The registered queries of the imaging operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxlake.sources.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over the tables and derived views."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = with_views(sql)
        return function

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from voxlake.plans import catalog_queries, deid_queries, document_queries, file_queries, function_queries, geometry_queries, multiframe_queries, pixel_queries, rt_queries, source_queries, syntax_queries  # noqa: F401

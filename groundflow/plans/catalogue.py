"""All queries of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundflow.plans import analysis_queries, registry, stream_queries, streamed_queries

assert analysis_queries and stream_queries and streamed_queries  # importing them registers their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    return registry.oracle_sql()

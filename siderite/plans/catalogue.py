"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siderite.plans import data_queries, data_sql, landed_queries, reference_queries, reference_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return data_queries.QUERIES | reference_queries.QUERIES | landed_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return data_sql.SQL | reference_sql.SQL | landed_queries.SQL

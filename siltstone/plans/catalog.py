"""Registry of the core queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import batch_queries, fold_queries, host_queries, page_queries, roundtrip_queries, rule_queries, sql_queries

_MODULES = (page_queries, host_queries, batch_queries, fold_queries, roundtrip_queries, rule_queries, sql_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}

"""The named queries over the driver's tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import delivery_queries, kernel_queries, label_queries, plan_queries, script_queries, text_queries

_GROUPS = (plan_queries, text_queries, script_queries, kernel_queries, label_queries, delivery_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for group in _GROUPS for name, f in group.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for group in _GROUPS for name, sql in group.ORACLE.items()}

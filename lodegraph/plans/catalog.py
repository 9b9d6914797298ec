"""All queries of the package but those of the text operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodegraph.plans import context_plans, core, event_plans, graph_plans, ingest_plans, insight_plans, retrieval_plans, runtime_plans, table_plans

_PARTS = (core, graph_plans, table_plans, context_plans, event_plans, ingest_plans, insight_plans, retrieval_plans, runtime_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}

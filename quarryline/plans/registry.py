"""The queries of the reference's own operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, io_queries, planner_queries, record_queries, retrieval_queries, text_queries, training_queries

MODULES = (text_queries, retrieval_queries, evaluation_queries, record_queries, planner_queries, training_queries, io_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}

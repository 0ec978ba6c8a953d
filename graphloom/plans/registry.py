"""Registered queries, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with its SQL if there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return add


from graphloom.plans import answer_queries, context_queries, csv_queries, graph_queries, index_queries, log_queries, monitor_queries, network_queries, path_queries, question_queries, statistics_queries, store_queries, stream_queries, traversal_queries  # noqa: E402, F401

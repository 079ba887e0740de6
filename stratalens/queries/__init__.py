"""Registered queries: each runs over whole tables, most with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries and their SQL, by name."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return put


def collected() -> tuple[dict[str, Query], dict[str, str]]:
    from . import clustering, evaluation, graph, linalg, regression, stats, text, topology

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (text, graph, clustering, evaluation, topology, stats, linalg, regression):
        queries |= module.R.queries
        sql |= module.R.sql
    return queries, sql

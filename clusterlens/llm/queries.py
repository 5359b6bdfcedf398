"""The queries of the operators, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clusterlens.llm.ship import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``function(read) -> DataFrame``; ``read(table)`` gives a table of the folder."""

    def register(function: Callable) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return function(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register

"""Registration of queries and access to the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The test tables as attributes, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        # Timestamps are stored without a zone: read them as UTC instants, so that filters
        # on them reach the Parquet scan without a cast in between.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``function(tables) -> DataFrame`` under a name, with its SQL counterpart."""

    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sql_uuid5(space: str, data: str) -> str:
    """SQL expression of a version 5 UUID; both arguments are SQL expressions."""
    digest = f"sha1(unhex(replace({space}, '-', '')) || encode({data}))"
    return (
        f"(SELECT concat(substr(h,1,8),'-',substr(h,9,4),'-5',substr(h,14,3),'-',"
        f"substr('89ab', (instr('0123456789abcdef', substr(h,17,1)) - 1) % 4 + 1, 1),substr(h,18,3),'-',substr(h,21,12))"
        f" FROM (SELECT {digest} AS h))"
    )


OBJECT_SPACE = "'3f249403-2bb0-428f-8e91-504d1fd7ddb6'"

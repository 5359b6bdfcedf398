"""Batch and streaming readers; every schema is explicit, nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clusterlens import schemas
from clusterlens.functions.ids import ensure_uuid


def parse_objects(documents: DataFrame, kind: str, column: str = "raw") -> DataFrame:
    """Object rows from JSON documents; the document itself is kept in ``raw``."""
    parsed = F.from_json(column, schemas.object_schema(kind))
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, F.col(column).alias("raw"), parsed.alias("_object")).select(*rest, "raw", "_object.*")


def read_objects(spark: SparkSession, path: str | Sequence[str], kind: str, *, listing: bool = False) -> DataFrame:
    """All objects of a kind from a snapshot.

    Normally one object per line, which splits into any number of tasks.  ``listing`` reads
    API list documents (``{"items": [...]}``), one page per file; page the dump so that a
    page fits a task.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not listing:
        return parse_objects(spark.read.text(paths).where(F.trim("value") != "").withColumnRenamed("value", "raw"), kind)
    pages = spark.read.schema("items ARRAY<STRING>").option("multiLine", True).json(paths)
    return parse_objects(pages.select(F.explode("items").alias("raw")), kind)


def read_changes(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of change records from a folder of JSON lines (or use any source with this schema)."""
    return spark.readStream.schema(schemas.CHANGE).options(**options).json(path)


def change_objects(changes: DataFrame, kind: str) -> DataFrame:
    """Change records of one kind with the object parsed; deletes may carry the last known state or none."""
    rows = changes.where(F.col("kind") == kind).withColumn("change_uuid", ensure_uuid(F.col("uid")))
    return parse_objects(rows.withColumnRenamed("object", "raw").drop("kind"), kind)


def scan_table(table: DataFrame, columns: Sequence[str], cluster: Column) -> DataFrame:
    """Some columns of one cluster's rows.

    The selection prunes columns; where the table is partitioned by cluster, the filter prunes
    partitions.
    """
    return table.where(F.col("cluster_uuid") == cluster).select(*columns)


META = ("uuid", "cluster_uuid", "uid", "namespace", "name", "resource_version", "created")


def read_samples(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """Metric samples in Parquet, best partitioned by metric and date."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.SAMPLE).parquet(path)


def read_incidents(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Open incidents, flattened to their tags.

    With ``lines`` there is one incident per line, which splits into any number of tasks; without,
    a file is one JSON array and is read by one task.
    """
    return spark.read.schema(schemas.INCIDENT).option("multiLine", not lines).json(path).select("object_tags.*")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RULE).json(path)


def decoded_rules(rules: DataFrame) -> DataFrame:
    """Rules with their filter decoded; an empty filter decodes to NULL and matches everything."""
    return rules.select("id", F.from_json(F.nullif("filter", F.lit("")), schemas.RULE_FILTER).alias("rule"))


def settings(rows: DataFrame, cluster: Column | None = None, keys: Sequence[str] = schemas.SETTING_KEYS) -> DataFrame:
    """Key/value settings as one wide row per cluster; only that of ``cluster`` if given."""
    rows = rows.where(F.col("cluster_uuid") == cluster) if cluster is not None else rows
    return rows.groupBy("cluster_uuid").agg(
        *[F.max(F.when(F.col("key") == key, F.col("value"))).alias(key.replace(".", "_")) for key in keys]
    )


def read_log_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stream of log text; a file holds what one container wrote since the last fetch.

    Folder layout: ``pod_uuid=.../container_uuid=.../<seq>.log``.
    """
    lines = spark.readStream.text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return lines.select(
        F.regexp_extract(name, "container_uuid=([^/]+)", 1).alias("container_uuid"),
        F.regexp_extract(name, "pod_uuid=([^/]+)", 1).alias("pod_uuid"),
        F.regexp_extract(name, r"([0-9]+)\.log$", 1).try_cast("bigint").alias("seq"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("ts"),
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the lines of log files of any size, each with the split it comes from.

    Folder layout: ``pod_uuid=.../container_uuid=.../`` and in it ``<seq>.log``, or ``seq=<seq>/`` with a file.  A large file is
    read by many tasks; ``operators.logs.line_chunks`` puts its lines in order again.
    """
    name = F.col("_metadata.file_path")
    seq = F.regexp_extract(name, r"(?:/seq=|/)([0-9]+)(?:\.log|/[^/]*)$", 1)
    return spark.readStream.option("lineSep", "\n").text(path).select(
        F.regexp_extract(name, "container_uuid=([^/]+)", 1).alias("container_uuid"),
        F.regexp_extract(name, "pod_uuid=([^/]+)", 1).alias("pod_uuid"),
        seq.try_cast("bigint").alias("seq"),
        F.col("value").alias("text"),
        F.col("_metadata.file_modification_time").alias("ts"),
        name.alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"),
    )

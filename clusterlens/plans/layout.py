"""Stored tables partitioned by cluster and date.

Plain Parquet folders ``cluster_uuid=.../date=...``.  Writing replaces the partitions that the rows belong to and
no others (dynamic partition overwrite); reading one cluster or a span of days opens their folders only.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clusterlens.operators.merge import vanished
from clusterlens.session import scratch_dir

CLUSTER, DATE = "cluster_uuid", "date"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def drop_folder(spark: SparkSession, path: str) -> None:
    found, system = _path(spark, path)
    system.delete(found, True)


class PartitionedTable:
    """A table partitioned by cluster and, with ``time``, by the date of that column."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time: str | None = None) -> None:
        self.spark, self.path, self.schema, self.time = spark, path.rstrip("/"), schema, time
        self.parts = [CLUSTER, DATE] if time else [CLUSTER]

    def replace(self, rows: DataFrame) -> None:
        """Replace the partitions that the rows belong to."""
        if self.time:
            rows = rows.withColumn(DATE, F.to_date(self.time))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)

    def read(self) -> DataFrame:
        fields = [*[f for f in self.schema.fields if f.name != CLUSTER], T.StructField(CLUSTER, T.StringType())]
        schema = T.StructType([*fields, *([T.StructField(DATE, T.DateType())] if self.time else [])])
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)

    def of_cluster(self, cluster: str, since: date | None = None) -> DataFrame:
        """One cluster's rows, from a day on if the table has dates; only their partitions are read."""
        rows = self.read().where(F.col(CLUSTER) == cluster)
        return rows if since is None else rows.where(F.col(DATE) >= F.lit(since))

    def rewrite(self, rows: DataFrame) -> None:
        """:meth:`replace` for rows that come from this very table: they are written aside first."""
        folder = scratch_dir(self.spark, "rewrite")
        rows.drop(DATE).write.parquet(folder)
        self.replace(self.spark.read.schema(rows.drop(DATE).schema).parquet(folder))
        drop_folder(self.spark, folder)

    def reconcile(self, listed: DataFrame, cluster: str, key: str = "uuid") -> DataFrame:
        """Drop a cluster's rows that are not listed any more; returns their keys.  Other clusters are not read."""
        stored = self.of_cluster(cluster)
        folder = scratch_dir(self.spark, "vanished")
        vanished(stored, listed, key).write.parquet(folder)
        gone = self.spark.read.schema(stored.select(key).schema).parquet(folder)
        kept = stored.join(gone, key, "left_anti").select(stored.columns)
        if kept.isEmpty():
            drop_folder(self.spark, f"{self.path}/{CLUSTER}={cluster}")
        else:
            self.rewrite(kept)
        return gone

    def _days(self) -> list[tuple[str, date]]:
        """All partitions: folder and date."""
        found, system = _path(self.spark, f"{self.path}/{CLUSTER}=*/{DATE}=*")
        folders = [status.getPath().toString() for status in system.globStatus(found) or []]
        return [(folder, date.fromisoformat(folder.rsplit("=", 1)[1])) for folder in folders if not folder.endswith("__HIVE_DEFAULT_PARTITION__")]

    def expire(self, now: datetime, days: int = 1) -> int:
        """Drop rows older than ``days``; returns the number of partitions dropped.

        Partitions before the border day go as folders, without being read; that of the border day is rewritten, and
        all later ones keep their files.  Rows without a time stay.
        """
        border = now - timedelta(days=days)
        expired = [folder for folder, day in self._days() if day < border.date()]
        for folder in expired:
            drop_folder(self.spark, folder)
        edge = self.read().where(F.col(DATE) == F.lit(border.date()))
        limit = F.lit(border.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")
        kept = edge.where(F.col(self.time) >= limit)
        if edge.where(F.col(self.time) < limit).isEmpty():
            return len(expired)
        whole = {r[CLUSTER] for r in edge.select(CLUSTER).distinct().collect()} - {r[CLUSTER] for r in kept.select(CLUSTER).distinct().collect()}
        self.rewrite(kept)
        for cluster in whole:  # nothing was left to replace these by
            drop_folder(self.spark, f"{self.path}/{CLUSTER}={cluster}/{DATE}={border.date()}")
        return len(expired) + len(whole)

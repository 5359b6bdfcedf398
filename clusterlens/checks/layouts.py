"""Stored tables partitioned by cluster and date."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

from clusterlens.checks.base import query
from clusterlens.plans.layout import PartitionedTable
from clusterlens.session import scratch_dir
from clusterlens.sources.readers import scan_table

_ROWS = "SELECT event_id, 'c' || user_id % 3 AS cluster_uuid, event_type, ts, value FROM events"


def _stored(t, name: str) -> PartitionedTable:
    rows = t.events.select("event_id", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("cluster_uuid"), "event_type", "ts", "value")
    table = PartitionedTable(t.spark, scratch_dir(t.spark, name), rows.schema, "ts")
    table.replace(rows)
    return table


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "cluster_uuid", F.unix_millis("ts").alias("ms"), "value")


_SHOWN = "SELECT event_id, cluster_uuid, epoch_us(ts) // 1000 AS ms, value FROM"


@query("scan_partition", f"{_SHOWN} ({_ROWS}) WHERE cluster_uuid = 'c1' AND ts >= TIMESTAMP '2024-01-20'")
def scan_partition(t):
    """Some columns of one cluster since a day: only its partitions of these days are read."""
    table = _stored(t, "scan")
    rows = table.of_cluster("c1", date(2024, 1, 20))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_uuid" in plan and "DataFilters: []" in plan, plan
    return _shown(scan_table(rows, ["event_id", "cluster_uuid", "ts", "value"], F.lit("c1")))


@query("partition_overwrite", f"{_SHOWN} (SELECT * REPLACE (CASE WHEN cluster_uuid = 'c2' AND ts::DATE = DATE '2024-01-10' THEN -value ELSE value END AS value) FROM ({_ROWS}))")
def partition_overwrite(t):
    """Rows of one partition are written again; all other files stay."""
    table = _stored(t, "overwrite")
    before = set(table.read().inputFiles())
    changed = table.of_cluster("c2").where("date = DATE '2024-01-10'").withColumn("value", -F.col("value"))
    table.rewrite(changed)
    after = set(table.read().inputFiles())
    assert {f for f in before if "cluster_uuid=c2/date=2024-01-10" not in f} == {f for f in after if "cluster_uuid=c2/date=2024-01-10" not in f}
    return _shown(table.read())


@query("partition_reconcile", f"{_SHOWN} ({_ROWS}) WHERE cluster_uuid <> 'c0' OR event_id % 4 <> 0")
def partition_reconcile(t):
    """What one cluster does not list any more is dropped; the files of the others are neither read nor written."""
    table = _stored(t, "reconcile")
    others = {f for f in table.read().inputFiles() if "cluster_uuid=c0" not in f}
    table.reconcile(t.events.where("event_id % 4 <> 0").select("event_id"), "c0", "event_id")
    assert others == {f for f in table.read().inputFiles() if "cluster_uuid=c0" not in f}
    return _shown(table.read())


@query("retention_table", f"{_SHOWN} ({_ROWS}) WHERE ts >= TIMESTAMP '2024-01-12 12:00:00'")
def retention_table(t):
    """Expired partitions go whole, that of the border day is rewritten, all others keep their files."""
    table = _stored(t, "retention")
    later = {f for f in table.read().inputFiles() if f.split("date=")[1][:10] > "2024-01-12"}
    dropped = table.expire(datetime(2024, 1, 15, 12), days=3)
    left = set(table.read().inputFiles())
    assert dropped > 0 and later <= left and all(f.split("date=")[1][:10] >= "2024-01-12" for f in left)
    return _shown(table.read())

"""Stream operators whose state lies in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil, sqrt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from clusterlens.operators.merge import DELETED

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTITIONS = "spark.sql.shuffle.partitions"

# A state has so many times the square root of the session's shuffle partitions, and never more than those.
SPREAD = 8


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query with state.

    Each task over a state tells the driver a figure of every partition of the state, so what is sent grows with the square of
    their number.  With :data:`SPREAD` it grows with the shuffle partitions instead.  The checkpoint keeps the number that it
    was made with.
    """
    before = spark.conf.get(_PARTITIONS)
    spark.conf.set(_PARTITIONS, str(min(int(before), ceil(SPREAD * sqrt(int(before))))))
    try:
        return writer.start()  # the query has a copy of the settings
    finally:
        spark.conf.set(_PARTITIONS, before)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings that a query with :func:`delete_once` has to be started under.

    Such a state needs the RocksDB store.  It expires by the clock, so batches without data would
    follow each other without end; the next batch with data evicts what has expired.
    """
    before = {key: spark.conf.get(key, None) for key in (_PROVIDER, _NO_DATA)}
    spark.conf.set(_PROVIDER, _ROCKS)
    spark.conf.set(_NO_DATA, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _first_delete(hours: int) -> StatefulProcessor:
    class FirstDelete(StatefulProcessor):
        """Per object: the sequence number of the delete that counted, until the object is back or the time is over."""

        def init(self, handle) -> None:
            self.counted = handle.getValueState("counted", "seq BIGINT", hours * 3_600_000)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            for row in sorted(rows, key=lambda r: r["seq"]):
                if row["op"] != DELETED:
                    if self.counted.exists() and self.counted.get()[0] < row["seq"]:
                        self.counted.clear()
                elif not self.counted.exists():
                    self.counted.update((row["seq"],))
                    yield Row(cluster_uuid=key[0], kind=key[1], uid=key[2], seq=row["seq"])

        def close(self) -> None:
            pass

    return FirstDelete()  # a class of a function travels to the executors with its code


def delete_once(changes: DataFrame, hours: int = 24) -> DataFrame:
    """Of a stream of change records, the deletes that count: the first one of an object until it is back.

    The state is one number per deleted object and is dropped after ``hours`` or as soon as a newer change shows the object
    again, so it grows with recent deletes only.  It lies in the checkpoint and survives restarts.  Start the
    query within :func:`keyed_state`.
    """
    slim = changes.select("cluster_uuid", "kind", "uid", "seq", "op")
    return slim.groupBy("cluster_uuid", "kind", "uid").transformWithState(
        statefulProcessor=_first_delete(hours),
        outputStructType="cluster_uuid STRING, kind STRING, uid STRING, seq BIGINT",
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def first_deliveries(changes: DataFrame, within: str = "1 hour", received: str = "received") -> DataFrame:
    """A stream of change records without those that were already delivered ``within`` that time.

    A record is known by its cluster, kind, uid and sequence number.  The state is one entry per record of the
    time span and is dropped by the watermark on the column ``received``.
    """
    return changes.withWatermark(received, within).dropDuplicatesWithinWatermark(["cluster_uuid", "kind", "uid", "seq"])

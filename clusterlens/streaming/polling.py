"""Metrics evaluated as their samples arrive.

Each micro-batch condenses its samples into *step states*: per series and step of the grid, the samples in the order of their
time.  States are merged by uniting them, in any order and also twice, so what carries over between batches is exact
whichever way samples are spread over them.  (First and last value and losses of a step could not be merged where two batches
interleave within a step.)  States lie in Parquet, partitioned by hour and batch: a batch adds its own partitions, a
batch that is retried replaces them, and nothing is rewritten.

A batch then evaluates the hours that its samples can be seen from, out of the states of these hours and the one before,
and replaces the result's partitions of these hours.  A window that spans two batches is so made of both.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from clusterlens.operators import metrics as m
from clusterlens.plans import catalog
from clusterlens.plans.layout import drop_folder, exists
from clusterlens.session import scratch_dir

HOUR = 3_600_000
ROWS = "entity_uuid STRING, timestamp BIGINT, category STRING, name STRING, value DOUBLE, hour BIGINT"


def _utc() -> datetime:
    return datetime.now(timezone.utc)


class Refreshed:
    """A small table that is read anew when the copy read last is older than ``every``; batches in between share the copy."""

    def __init__(
        self, spark: SparkSession, load: Callable[[], DataFrame], every: timedelta = timedelta(hours=1), clock: Callable[[], datetime] = _utc
    ) -> None:
        self._spark, self._load, self._every, self._clock = spark, load, every, clock
        self._folder, self._frame, self._read = "", None, None

    def __call__(self) -> DataFrame:
        now = self._clock()
        if self._frame is None or now - self._read >= self._every:
            folder, frame = scratch_dir(self._spark, "dimension"), self._load()
            frame.write.parquet(folder)
            if self._folder:  # batches are one after another: nothing reads it any more
                drop_folder(self._spark, self._folder)
            self._folder, self._frame, self._read = folder, self._spark.read.schema(frame.schema).parquet(folder), now
        return self._frame


class StepStates:
    """The samples of a stream by series and step, in Parquet partitioned by hour and batch."""

    def __init__(self, spark: SparkSession, path: str, scope: Sequence[str] = (), step: int = m.MINUTE) -> None:
        self.spark, self.path, self.scope, self.step = spark, path, tuple(scope), step
        columns = "".join(f"{c} STRING, " for c in self.scope)
        pairs = "pairs ARRAY<STRUCT<key: STRING, value: STRING>>"
        self.schema = f"{columns}metric STRING, {pairs}, slot BIGINT, samples ARRAY<STRUCT<t: BIGINT, value: DOUBLE>>, hour BIGINT, batch BIGINT"

    def _key(self) -> list[str]:
        return [*self.scope, "metric", "pairs", "slot", "hour"]

    def add(self, samples: DataFrame, number: int) -> list[int]:
        """Store a batch; returns the hours it has samples of."""
        t = F.unix_millis("ts")
        slot = F.floor(t / F.lit(self.step)).cast("bigint") * F.lit(self.step)
        rows = samples.select(
            *self.scope, "metric", F.sort_array(F.map_entries("labels")).alias("pairs"), slot.alias("slot"), F.struct(t.alias("t"), "value").alias("sample")
        ).withColumn("hour", F.floor(F.col("slot") / F.lit(HOUR)).cast("bigint"))
        states = rows.groupBy(*self._key()).agg(F.sort_array(F.collect_set("sample")).alias("samples"))
        stored = states.withColumn("batch", F.lit(number).cast("bigint"))
        stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(self.path)
        if not exists(self.spark, self.path):
            return []
        own = self._read().where(F.col("batch") == number).select("hour").distinct()
        return sorted(r.hour for r in own.collect())  # one row per hour that the batch spans

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def samples(self, hours: Sequence[int], once: bool = True) -> DataFrame:
        """All samples of some hours, each once; only their partitions are read.

        Without ``once`` the states of different batches are not brought together, so a sample that several batches
        delivered is there several times.
        """
        merged = self._read().where(F.col("hour").isin(*hours))
        if once:
            merged = merged.groupBy(*self._key()).agg(F.array_distinct(F.flatten(F.collect_list("samples"))).alias("samples"))
        labels = F.map_from_entries("pairs").alias("labels")
        each = merged.select(*self.scope, "metric", labels, F.explode("samples").alias("s"))
        return each.select(*self.scope, "metric", "labels", F.timestamp_millis("s.t").alias("ts"), F.col("s.value").alias("value"))

    def forget(self, before: int) -> None:
        """Drop the hours before the given one (in hours since the epoch); later samples of theirs then count alone."""
        hours = self._read().where(F.col("hour") < before).select("hour").distinct().collect()
        for row in hours:
            drop_folder(self.spark, f"{self.path}/hour={row.hour}")


def metric_level(
    samples: DataFrame,
    level: str,
    states: StepStates,
    target: str,
    *,
    lookups: Callable[[], dict],
    grid: dict | None = None,
) -> DataStreamWriter:
    """Keep the metric rows of a level in step with a stream of samples (see :func:`read_rows`).

    ``lookups`` gives the look-up tables of :func:`catalog.metric_rows`, per batch; a :class:`Refreshed` node or pod
    dimension is read by the clock.
    """
    grid = dict(grid or {})
    reach = max(grid.get("lookback", m.LOOKBACK), 2 * m.MINUTE)  # no rate of the catalogue looks back further than two minutes

    def apply(batch: DataFrame, number: int) -> None:
        touched = states.add(batch, number)
        if not touched:
            return
        ahead = -(-reach // HOUR)
        due = sorted({hour + k for hour in touched for k in range(ahead + 1)})
        # What several batches delivered is left to the evaluation, which brings the samples of a series together once.
        known = states.samples(sorted({hour - k for hour in due for k in range(ahead + 1)}), once=False)
        rows = catalog.level_rows(level, known, grid={**grid, "repeated": True}, **lookups())
        hour = F.floor(F.col("timestamp") / F.lit(HOUR)).cast("bigint")
        fresh = rows.withColumn("hour", hour).where(F.col("hour").isin(*due))
        # An hour that has no rows left still gets its partition replaced, by one row without an entity.
        none = states.spark.createDataFrame([(None, None, None, None, None, h) for h in due], ROWS)
        whole = fresh.select(*none.columns).unionByName(none).repartition("hour")
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour").parquet(target)

    return samples.writeStream.foreachBatch(apply)


def read_rows(spark: SparkSession, target: str) -> DataFrame:
    """The metric rows of :func:`metric_level`, partitioned by hour."""
    return spark.read.schema(ROWS).parquet(target).where(F.col("entity_uuid").isNotNull())

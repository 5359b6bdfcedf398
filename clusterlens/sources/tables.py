"""Keyed tables on plain Parquet.

A table is a folder of immutable batches, ``batch_id=N/step=S/writer=W``.  A batch holds
changed rows and tombstones; writing a batch again replaces it, so a retried micro-batch is
idempotent and costs only the size of the change, never of the table.  Every row and tombstone
carries the sequence number of the change it comes from, and reading takes the row of the
highest one per key, whichever writer wrote it and in whatever batch; at equal numbers an upsert
wins over a delete, then the later batch, then the row listed last (``_listed``).  :meth:`KeyedTable.compact` folds all batches into a new folder; readers
of the old one keep their files.  With a table format that has row-level merges use
``DataFrame.mergeInto`` instead; the pure functions in ``operators.merge`` serve both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clusterlens.operators.merge import latest_per_key

SEQ, LISTED = "_seq", "_listed"
_BATCH, _STEP, _WRITER, _GONE = "batch_id", "step", "writer", "_deleted"
_ORDER = (SEQ, _STEP, _BATCH, _WRITER, LISTED)

# A join may broadcast a change of up to so many rows.
FEW = 20_000


def sized(rows: DataFrame) -> DataFrame:
    """Rows of a change as a side of joins, which broadcast them, and never the other side, if a count says that they are few.

    The optimiser estimates some columns of wide rows by the share of their declared widths in the size of the files, which
    is far too small for the keys of objects, those of a change and those stored; any number of them would then be sent
    through the driver.
    """
    return F.broadcast(rows) if few(rows) else rows.hint("merge")


def few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW


class KeyedTable:
    """One keyed table: ``upsert``, ``delete`` and ``read``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path, schema, tuple(keys)

    def _write(self, rows: DataFrame, batch: int, step: int, writer: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{_BATCH}={batch}/{_STEP}={step}/{_WRITER}={writer}")

    @staticmethod
    def _sequence(rows: DataFrame, default: int) -> Column:
        return (F.coalesce(F.col(SEQ), F.lit(default)) if SEQ in rows.columns else F.lit(default)).cast("bigint").alias(SEQ)

    def upsert(self, rows: DataFrame, batch: int, writer: str = "main", seq: int | None = None) -> None:
        """Insert or replace whole rows.

        The sequence number is that of the column ``_seq``, else ``seq``, else the batch number
        (for tables of one writer).  Rows may share a key if a column ``_listed`` orders them.
        """
        listed = [c for c in rows.columns if c == LISTED]
        known = rows.select(*self.schema.names, self._sequence(rows, batch if seq is None else seq), *listed)
        self._write(known.withColumn(_GONE, F.lit(False)), batch, 2, writer)

    def delete(self, keys: DataFrame, batch: int, writer: str = "main", seq: int | None = None) -> None:
        """Drop rows by key.  An upsert of the same sequence number wins over a delete."""
        known = keys.select(*self.keys, self._sequence(keys, batch if seq is None else seq))
        self._write(known.withColumn(_GONE, F.lit(True)), batch, 1, writer)

    def batch(self, number: int, writer: str = "main") -> DataFrame:
        """The rows one batch upserted, with their sequence numbers."""
        folder = f"{self.path}/{_BATCH}={number}/{_STEP}=2/{_WRITER}={writer}"
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType())])).parquet(folder)

    def read(self, before: int | None = None, only: DataFrame | None = None, writer: str = "main") -> DataFrame:
        """Current rows, or those without a writer's own batches from ``before`` on.

        A retried batch so does not see itself; what other writers wrote is always seen, since
        their batch numbers say nothing about this one's.  ``only`` limits the rows to its
        values of key columns; it is applied before the versions are compared, so a small
        change looks up a large table without shuffling all of it.
        """
        log = self._log(before, writer)
        if only is not None:
            shared = [k for k in self.keys if k in only.columns]
            log = log.join(sized(only.select(*shared)), shared, "left_semi")
        latest = latest_per_key(log, self.keys, _ORDER)
        return latest.where(~F.col(_GONE)).select(self.schema.names)

    def keys_where(self, fixed: Column, before: int | None = None, writer: str = "main") -> DataFrame:
        """Keys of the current rows that meet a condition on columns that never change for a key.

        The scan filters by it, and nothing but keys is shuffled.
        """
        log = self._log(before, writer).where(fixed | F.col(_GONE)).select(*self.keys, _GONE, *_ORDER)
        return latest_per_key(log, self.keys, _ORDER).where(~F.col(_GONE)).select(*self.keys)

    def keys_of(self, parents: DataFrame, foreign_key: str, before: int | None = None, writer: str = "main") -> DataFrame:
        """Keys of all rows that ever belonged to the parents (their foreign key never changes).

        A sequence number of the parents goes along.
        """
        rows = self._log(before, writer).where(~F.col(_GONE)).drop(SEQ)
        if SEQ not in parents.columns:
            return rows.join(parents.select(foreign_key), foreign_key, "left_semi").select(*self.keys).distinct()
        latest = parents.groupBy(foreign_key).agg(F.max(SEQ).alias(SEQ))
        return rows.join(latest, foreign_key).groupBy(*self.keys).agg(F.max(SEQ).alias(SEQ))

    def deleted_since(self, rows: DataFrame) -> DataFrame:
        """Keys of rows that a change with a higher sequence number deleted."""
        gone = self._log(None, "").where(F.col(_GONE)).select(*self.keys, F.col(SEQ).alias("_at"))
        return rows.join(gone, list(self.keys)).where(F.col("_at") > F.col(SEQ)).select(*self.keys).distinct()

    def _log(self, before: int | None, writer: str) -> DataFrame:
        schema = T.StructType(
            [
                *self.schema.fields,
                T.StructField(SEQ, T.LongType()),
                T.StructField(LISTED, T.LongType()),
                T.StructField(_GONE, T.BooleanType()),
                T.StructField(_BATCH, T.LongType()),
                T.StructField(_STEP, T.IntegerType()),
                T.StructField(_WRITER, T.StringType()),
            ]
        )
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        return log if before is None else log.where((F.col(_BATCH) < before) | (F.col(_WRITER) != writer))

    def compact(self, target: str) -> "KeyedTable":
        """Current rows as a new table of one batch."""
        compacted = KeyedTable(self.spark, target, self.schema, self.keys)
        latest = latest_per_key(self._log(None, ""), self.keys, _ORDER)
        compacted.upsert(latest.where(~F.col(_GONE)), 0)
        return compacted

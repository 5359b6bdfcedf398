"""Container log tails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from clusterlens.functions.text import utf8_tail
from clusterlens.session import scratch_dir

# Fixed value: bytes kept per container.
LOG_BYTES = 65_535

# Up to so many started containers are sent to all tasks.
FEW_CONTAINERS = 20_000

# Binary digits by which each look at the positions is finer than the one before.
_STEP = 12


def _after(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Bytes of the key behind each row."""
    later = Window.partitionBy(*keys).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_after", F.coalesce(F.sum("_bytes").over(later), F.lit(0)))


def log_tails(
    chunks: DataFrame,
    keys: Sequence[str] = ("container_uuid",),
    seq: str = "seq",
    body: str = "text",
    size: int = LOG_BYTES,
) -> DataFrame:
    """The last ``size`` bytes of the concatenated chunks per key, starting at a whole line.

    ``seq`` is a unique position per key, dense or not.  The sizes of the chunks are written
    once, without their text.  Positions are looked at by their leading binary digits, coarse
    first: partial sums per stretch of positions tell which stretches can reach into the tail, and
    only those are looked at more closely.  So a key with any number of chunks brings a bounded
    number of rows to one task: at most one stretch for each byte of the tail, and the parts of
    the one in which the tail begins.  The text is joined to the chosen chunks alone, cut to its own last bytes.
    """
    spark = chunks.sparkSession
    folder = scratch_dir(spark, "logs")
    measured = chunks.select(*keys, F.col(seq).cast("bigint").alias("_seq"), F.octet_length(body).cast("bigint").alias("_bytes"))
    measured.where("_bytes > 0").write.parquet(folder)
    rows = spark.read.schema(measured.schema).parquet(folder)
    low, high = rows.agg(F.min("_seq"), F.max("_seq")).first()
    digits = (high - low).bit_length() if low is not None else 0
    for shift in range(_STEP * (digits // _STEP), 0, -_STEP):
        ranged = rows.withColumn("_range", F.shiftright("_seq", shift))
        totals = ranged.groupBy(*keys, "_range").agg(F.sum("_bytes").alias("_bytes"))
        # "<=": one byte more than the tail must survive where there is more, to see the cut.
        reaching = _after(totals, keys, "_range").where(F.col("_after") <= size).select(*keys, "_range")
        rows = ranged.join(reaching, [*keys, "_range"], "left_semi").drop("_range")
    wanted = _after(rows, keys, "_seq").where(F.col("_after") <= size).select(*keys, "_seq")
    # A character has a byte at least, so this many characters hold the tail and one byte before it.
    text = chunks.select(*keys, F.col(seq).cast("bigint").alias("_seq"), F.right(F.col(body), F.lit(size + 1)).alias("_text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_seq", "_text"))), lambda c: c["_text"])
    return (
        text.join(wanted, [*keys, "_seq"])
        .groupBy(*keys)
        .agg(F.array_join(ordered, "").alias("_text"))
        .select(*keys, utf8_tail(F.col("_text"), size).alias("logs"))
    )


def append_logs(
    stored: DataFrame, chunks: DataFrame, size: int = LOG_BYTES, key: str = "container_uuid"
) -> DataFrame:
    """Append new chunks to stored tails and cut again.

    ``stored``: key, ``pod_uuid``, ``logs``, ``last_update``; ``chunks`` additionally has
    ``seq`` and ``ts``.  Containers without new chunks keep their row.
    """
    old = stored.select(key, "pod_uuid", F.lit(-1).cast("bigint").alias("seq"), F.col("logs").alias("text"), F.col("last_update").alias("ts"))
    both = old.unionByName(chunks.where(F.octet_length("text") > 0).select(key, "pod_uuid", "seq", "text", "ts"))
    latest = both.groupBy(key).agg(F.max_by("pod_uuid", "seq").alias("pod_uuid"), F.max("ts").alias("last_update"))
    return latest.join(log_tails(both, [key], size=size), key).select(key, "pod_uuid", "logs", "last_update")


def wanted_chunks(chunks: DataFrame, containers: DataFrame) -> DataFrame:
    """Chunks of containers that are started; logs of others are not collected.

    Where a count says that few containers are started, no text is shuffled: a join by container would bring all chunks of
    one to one task.
    """
    started = containers.where(F.col("started")).select(F.col("uuid").alias("container_uuid"))
    few = started.limit(FEW_CONTAINERS + 1).count() <= FEW_CONTAINERS
    return chunks.join(F.broadcast(started) if few else started, "container_uuid", "left_semi")


def line_chunks(lines: DataFrame, containers: DataFrame) -> DataFrame:
    """Chunks of one line each, numbered per container, from the lines of one batch of ``read_log_lines``.

    Only started containers count.  The lines of a split are numbered by the task that reads it; sizes of all splits, one row
    each, then tell how many lines lie before it.  A file's last line gets a newline only if the file ends with one.
    The lines are written once to the shared folder, so that all steps see the same numbers.
    """
    spark = lines.sparkSession
    folder = scratch_dir(spark, "log-lines")
    read = wanted_chunks(lines.withColumn("_row", F.monotonically_increasing_id()), containers)
    read.write.parquet(folder)
    rows = spark.read.schema(read.schema).parquet(folder)
    split = ["container_uuid", "pod_uuid", "path", "block"]
    sizes = rows.groupBy(*split, "seq", "file_size").agg(
        F.min("_row").alias("_first"), F.max("_row").alias("_last"), F.sum(F.octet_length("text") + 1).alias("_bytes")
    )
    before = Window.partitionBy("container_uuid", "pod_uuid").orderBy("seq", "path", "block").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("container_uuid", "pod_uuid", "path")
    at_end = (F.col("block") == F.max("block").over(file)) & (F.sum("_bytes").over(file) == F.col("file_size") + 1)
    placed = sizes.select(
        *split,
        (F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.when(at_end, F.col("_last")).alias("_open"),
    )
    text = F.when(F.col("_row").eqNullSafe(F.col("_open")), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    joined = rows.drop("seq").join(placed, split)
    return joined.select("container_uuid", "pod_uuid", (F.col("_row") + F.col("_shift")).alias("seq"), text.alias("text"), "ts")

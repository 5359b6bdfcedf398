"""Packing documents into batches of equal padded length, with optimal length buckets.

One aggregation counts documents per length.  A dynamic program over that histogram chooses at most
``buckets`` upper bounds that minimise the total padding (every document is padded to the bound of
its bucket).  Inside a bucket, documents form batches of ``budget // bound`` rows (at least one),
so that a padded batch stays within the token budget; a document longer than the budget is a batch
of its own.

The histogram counts every length exactly.  It has at most sqrt(2 * tokens) lengths, since n different lengths take
n * (n - 1) / 2 tokens at least: 16 bytes each on the driver, and the program divides and conquers (``buckets`` * n * log n steps).
Ranks inside a bucket come from counts per slice of the bucket, so that a bucket holding most documents is numbered by many tasks.

Defined cases: a null or empty text has no tokens and is padded like any other; repeated rows are
packed once each; an empty table gives an empty result; columns of clashing names are no problem,
since only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import text as tx
from clusterlens.llm.staging import stage


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The upper bounds (ascending) that minimise the padding, and that padding.

    ``lengths`` are distinct and ascending; the last is always a bound.
    """
    if not len(lengths):
        return [], 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths)])
    n, far = len(lengths), np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        best, at = _one_more(best, lengths, rows, tokens)
        choice.append(at)
    found, j = [], n
    for at in reversed(choice):
        if j:
            found.append(int(lengths[j - 1]))
            j = int(at[j])
    return found[::-1], int(best[n])


def _one_more(best: np.ndarray, lengths: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of the first j lengths with one more bucket that ends at length j - 1, and where that bucket begins.

    The beginning never moves back as j grows (the padding has the quadrangle inequality), so the middle one of a range of j bounds those
    of both halves.  All ranges of one depth are searched together: about as many candidates as lengths.
    """
    n = len(lengths)
    now, at = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    first, last, low, high = (np.array([x], np.int64) for x in (1, n, 0, n - 1))  # ranges of j, and of beginnings
    while len(first):
        middle = (first + last) // 2
        width = np.minimum(high, middle - 1) - low + 1
        heads = np.cumsum(width) - width
        begin = np.arange(width.sum()) - np.repeat(heads - low, width)
        j = np.repeat(middle, width)
        cost = best[begin] + (rows[j] - rows[begin]) * lengths[j - 1] - (tokens[j] - tokens[begin])
        now[middle] = np.minimum.reduceat(cost, heads)
        least = np.flatnonzero(cost == np.repeat(now[middle], width))
        at[middle] = begin[least[np.searchsorted(least, heads)]]
        left, right = first < middle, middle < last
        first, last, low, high = (
            np.concatenate(x)
            for x in (
                (first[left], middle[right] + 1),
                (middle[left] - 1, last[right]),
                (low[left], at[middle][right]),
                (at[middle][left], high[right]),
            )
        )
    return now, at


def word_counts(documents: DataFrame, text: str) -> DataFrame:
    """The documents' other columns and ``n_tokens``: white-space separated words of the whole text."""
    carried = [c for c in documents.columns if c != text]
    schema = T.StructType([*[documents.schema[c] for c in carried], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                np.diff(tx.words(data, offsets, tx.NOT_SPACE)[2]) for _, _, data, offsets in tx.pieces(batch.column(batch.schema.names.index(text)))
            ]
            total = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in carried], pa.array(total)], names=schema.names)

    return documents.mapInArrow(tx.frugal(run), schema)


def pack(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = 16, budget: int = 8192, slices: int | None = None
) -> DataFrame:
    """Per document: id, ``n_tokens``, ``bucket`` (from 0), ``bound``, ``batch`` (inside the bucket) and ``slot`` in it.

    ``slices``: into how many parts each bucket is divided for numbering (default: the shuffle partitions).
    """
    spark = documents.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(word_counts(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text"), "packing")
    histogram = rows.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    lengths, counts = (histogram.column(c).to_numpy() for c in ("n_tokens", "count"))
    found, _ = bounds(lengths, counts, buckets)
    upper = F.array(*[F.lit(b).cast("bigint") for b in found]) if found else F.array(F.lit(0).cast("bigint"))
    placed = rows.select(
        "doc_id",
        "n_tokens",
        F.size(F.filter(upper, lambda b: b < F.col("n_tokens"))).alias("bucket"),
        F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)).cast("int").alias("slice"),
    )
    before = (
        placed.groupBy("bucket", "slice")
        .agg(F.count("*").alias("n"))
        .select("bucket", "slice", (F.sum("n").over(Window.partitionBy("bucket").orderBy("slice")) - F.col("n")).alias("before"))
    )
    own = Window.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens")
    rank = F.col("before") + F.row_number().over(own) - 1
    size = f"greatest({int(budget)} div greatest(bound, 1), 1)"
    return (
        placed.join(before, ["bucket", "slice"])
        .select("doc_id", "n_tokens", "bucket", upper[F.col("bucket")].alias("bound"), rank.alias("rank"))
        .select("doc_id", "n_tokens", "bucket", "bound", F.expr(f"rank div {size}").alias("batch"), F.expr(f"cast(rank % {size} AS int)").alias("slot"))
    )

"""Evaluation of metric samples on a regular time grid.

Samples are ``(metric, labels, ts, value)`` rows, optionally with scope columns such as
``cluster_uuid``.  A *vector* is a DataFrame with ``tick`` (epoch milliseconds), the label
columns it is grouped by and ``value``.

Plan shape.  Samples are shuffled once, by (series, time chunk).  A sample is copied into a
chunk only if it can still be seen from a tick of that chunk, so chunks are independent: a
series of any length is spread over as many tasks as it has chunks, and the ordering work
(``lead``/``lag``) stays inside one short chunk.  Everything up to the per-series result is
done on that partitioning; the label aggregation that follows combines on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

MINUTE = 60_000
LOOKBACK = 5 * MINUTE
CHUNK = 60 * MINUTE


def label(name: str) -> Column:
    """A label value; an absent label is the empty one."""
    return F.coalesce(F.element_at("labels", name), F.lit(""))


def equals(name: str, value: str) -> Column:
    return label(name) == value


def not_matching(name: str, pattern: str) -> Column:
    """Negative regular-expression matcher; patterns match the whole value."""
    return ~label(name).rlike(f"^(?:{pattern})$")


def _div(value: Column, by: int) -> Column:
    """Floor division of epoch milliseconds."""
    return F.floor(value / F.lit(by)).cast("bigint")


def _series(
    samples: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str],
    matchers: Sequence[Column],
    scope: Sequence[str],
) -> DataFrame:
    """Filtered samples with their series and grouping labels as columns.

    Undefined samples stay: the newest sample counts, and it is the result that is dropped.

    A series is its sorted label pairs.  Two hashes of them, 128 bits together, stand for it in
    shuffles: ``series_id``, which it is dealt by, and ``series``.
    """
    wanted = F.col("metric").isin(*metrics) if len(metrics) > 1 else F.col("metric") == metrics[0]
    keep = reduce(lambda a, b: a & b, matchers, wanted)
    pairs = F.sort_array(F.map_entries("labels"))
    return samples.where(keep).select(
        F.xxhash64(pairs).alias("series_id"),
        F.xxhash64(F.lit(1), pairs).alias("series"),
        *scope,
        *[label(name).alias(name) for name in by],
        "metric",
        F.unix_millis("ts").alias("t"),
        "value",
    )


def _chunked(series: DataFrame, scope: Sequence[str], reach: int, step: int, chunk: int) -> DataFrame:
    """Copy each sample into the chunks whose ticks can see it (``reach`` milliseconds ahead)."""
    if reach % step or chunk % step:
        raise ValueError("reach and chunk must be multiples of the step")
    first = _div(F.col("t") + F.lit(step - 1), step) * F.lit(step)
    last = _div(F.col("t") + F.lit(reach - 1), step) * F.lit(step)
    spread = series.withColumn("chunk", F.explode(F.sequence(_div(first, chunk), _div(last, chunk))))
    # The ticks follow from the time: they need not be shuffled.
    return spread.repartition(*scope, "series_id", "chunk").withColumn("first_tick", first).withColumn("last_tick", last)


def _ticks(low: Column, high: Column, step: int, chunk: int) -> Column:
    """Ticks from ``low`` to ``high`` that lie in the row's chunk; NULL (no rows) if there are none."""
    start = F.greatest(low, F.col("chunk") * F.lit(chunk))
    stop = F.least(high, (F.col("chunk") + F.lit(1)) * F.lit(chunk) - F.lit(step))
    return F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("bigint")))


def instants(
    samples: DataFrame,
    metrics: Sequence[str],
    by: Sequence[str] = (),
    matchers: Sequence[Column] = (),
    *,
    scope: Sequence[str] = (),
    step: int = MINUTE,
    lookback: int = LOOKBACK,
    chunk: int = CHUNK,
    repeated: bool = False,
) -> DataFrame:
    """Per series and tick the last sample of (tick - lookback, tick], for one or more metrics.

    Samples may be ``repeated``: of several at one time only the last one reaches a tick.
    """
    rows = _chunked(_series(samples, metrics, by, matchers, scope), scope, lookback, step, chunk)
    order = Window.partitionBy(*scope, "series_id", "chunk", "series", "metric").orderBy("t", "value")
    following = F.lead("t").over(order)
    # The last tick before the next sample of the series; unbounded if there is none.
    covered = F.coalesce(_div(following - F.lit(1), step) * F.lit(step), F.col("last_tick"))
    return rows.withColumn("covered", covered).select(
        *scope,
        "series_id",
        "series",
        *by,
        "chunk",
        "metric",
        F.explode(_ticks(F.col("first_tick"), F.least("last_tick", "covered"), step, chunk)).alias("tick"),
        "value",
    )


def instant(samples: DataFrame, metric: str, by: Sequence[str] = (), matchers: Sequence[Column] = (), **grid) -> DataFrame:
    """Instant vector of one metric."""
    return instants(samples, [metric], by, matchers, **grid)


def matched(
    samples: DataFrame, left: str, right: str, by: Sequence[str], value: Column, **grid
) -> DataFrame:
    """One-to-one arithmetic of two metrics on all labels.

    ``value`` is an expression over ``left`` and ``right``.  Both metrics share one shuffle;
    pairing them up is an aggregation on the partitioning that is already there, not a join.
    """
    scope = grid.get("scope", ())
    vectors = instants(samples, [left, right], by, **grid)

    def side(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("value")))

    return (
        vectors.groupBy(*scope, "series_id", "chunk", "series", *by, "tick")
        .agg(side(left).alias("left"), side(right).alias("right"))
        .where(F.col("left").isNotNull() & F.col("right").isNotNull())
        .select(*scope, "series", *by, "tick", "left", "right", value.alias("value"))
    )


def rate(
    samples: DataFrame,
    metric: str,
    window: int,
    by: Sequence[str] = (),
    matchers: Sequence[Column] = (),
    *,
    scope: Sequence[str] = (),
    step: int = MINUTE,
    chunk: int = CHUNK,
    repeated: bool = False,
) -> DataFrame:
    """Per-second increase of a counter over (tick - window, tick], per series and tick.

    A falling value is a counter reset.  The increase is extrapolated to the edges of the
    window: by at most half the average sample distance where the edge is further away than
    1.1 times that distance, and never to before the counter was zero.

    Samples are first condensed into one row per step, so a sample is stored once however
    many overlapping windows see it; the windows are then put together from steps.  If samples may be
    ``repeated``, equal ones of a series count once; they are next to each other where the series is put in order anyway.
    """
    rows = _chunked(_series(samples, [metric], by, matchers, scope), scope, window, step, chunk)
    key = [*scope, "series_id", "chunk", "series"]
    order = Window.partitionBy(*key).orderBy("t", "value")
    if repeated:
        before = F.lag(F.struct("t", "value")).over(order)
        rows = rows.withColumn("again", before.eqNullSafe(F.struct("t", "value"))).where("NOT again").drop("again")
    previous = F.lag("value").over(order)
    rows = rows.withColumns(
        {
            # What the counter had reached before it restarted at this sample.
            "lost": F.when(F.col("value") < previous, previous).otherwise(F.lit(0.0)),
            # Orders the samples like (t, value), but as one number, which aggregates in hash maps.
            "at": F.row_number().over(order),
        }
    )
    steps = rows.groupBy(*key, *by, F.col("first_tick").alias("slot")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("t").alias("first_t"),
        F.min_by("value", "at").alias("first_v"),
        F.max("t").alias("last_t"),
        F.max_by("value", "at").alias("last_v"),
        F.sum("lost").alias("lost"),
        F.min_by("lost", "at").alias("first_lost"),
    )
    seen = steps.withColumn(
        "tick", F.explode(_ticks(F.col("slot"), F.col("slot") + F.lit(window - step), step, chunk))
    )
    windows = (
        seen.groupBy(*key, *by, "tick")
        .agg(
            F.sum("n").alias("n"),
            F.min("first_t").alias("first_t"),
            F.min_by("first_v", "slot").alias("first_v"),
            F.max("last_t").alias("last_t"),
            F.max_by("last_v", "slot").alias("last_v"),
            # The first sample of the window has no predecessor inside the window.
            (F.sum("lost") - F.min_by("first_lost", "slot")).alias("lost"),
        )
        .where((F.col("n") >= 2) & (F.col("last_t") > F.col("first_t")))
    )
    return windows.select(*scope, "series", *by, "tick", _per_second(window).alias("value"))


def _per_second(window: int) -> Column:
    increase = F.col("last_v") - F.col("first_v") + F.col("lost")
    sampled = (F.col("last_t") - F.col("first_t")) / F.lit(1000.0)
    distance = sampled / (F.col("n") - F.lit(1))
    head = (F.col("first_t") - (F.col("tick") - F.lit(window))) / F.lit(1000.0)
    tail = (F.col("tick") - F.col("last_t")) / F.lit(1000.0)

    def edge(gap: Column) -> Column:
        return F.when(gap >= distance * F.lit(1.1), distance / F.lit(2.0)).otherwise(gap)

    to_zero = F.when(
        (increase > 0) & (F.col("first_v") >= 0), sampled * F.try_divide(F.col("first_v"), increase)
    )
    covered = sampled + F.least(edge(head), to_zero) + edge(tail)
    return increase * (covered / sampled) / F.lit(window / 1000.0)


# --------------------------------------------------------------------------- vectors


def aggregate(vector: DataFrame, by: Sequence[str], how: Column, scope: Sequence[str] = ()) -> DataFrame:
    """``how`` (an aggregate of ``value``) per tick and label values."""
    return vector.groupBy(*scope, *by, "tick").agg(how.alias("value"))


def sum_by(vector: DataFrame, by: Sequence[str] = (), scope: Sequence[str] = ()) -> DataFrame:
    return aggregate(vector, by, F.sum("value"), scope)


def avg_by(vector: DataFrame, by: Sequence[str] = (), scope: Sequence[str] = ()) -> DataFrame:
    return aggregate(vector, by, F.avg("value"), scope)


def count_series(vector: DataFrame, by: Sequence[str] = (), scope: Sequence[str] = ()) -> DataFrame:
    return aggregate(vector, by, F.count(F.lit(1)).cast("double"), scope)


def count_groups(vector: DataFrame, by: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Number of different label values per tick.

    Two aggregations instead of a distinct count: the inner one spreads the labels over all
    tasks, the outer one combines on the map side.
    """
    groups = vector.select(*scope, *by, "tick").distinct()
    return groups.groupBy(*scope, "tick").agg(F.count(F.lit(1)).cast("double").alias("value"))


def negate(vector: DataFrame) -> DataFrame:
    return vector.withColumn("value", -F.col("value"))


def divide(left: DataFrame, right: DataFrame, on: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """``left / right`` where many rows of ``left`` may match one row of ``right``.

    ``right`` is unique per ``on`` labels and tick.  Both sides are already aggregated, so the
    join is small next to the samples; its strategy is left to the optimiser, which sees the
    sizes.  Undefined and infinite results are dropped.
    """
    keys = [*scope, *on, "tick"]
    quotient = F.try_divide(F.col("value"), F.col("_right"))
    joined = left.join(right.select(*keys, F.col("value").alias("_right")), keys)
    return (
        joined.withColumn("value", quotient)
        .drop("_right")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .select(*left.columns)
    )


def minute_values(samples: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Last value per key and minute: a later sample of a minute replaces an earlier one.

    Undefined samples are left out, as a stream of them leaves what is stored.
    """
    defined = samples.where(~F.isnan(value))
    return defined.groupBy(*keys, F.date_trunc("minute", F.col(ts)).alias("minute")).agg(F.max_by(value, F.struct(ts, value)).alias("value"))

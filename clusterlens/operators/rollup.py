"""Roll-ups over child rows.

They use partially aggregating functions only, so a parent with very many children is
combined on the map side and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.quantity import mode_bit
from clusterlens.functions.state import OK

RESOURCES = ("cpu_limits", "cpu_requests", "memory_limits", "memory_requests")


def _need(resource: Column, is_app: Column) -> Column:
    # greatest() skips NULL, so a pod with only one side set takes that side.
    return F.greatest(F.sum(F.when(is_app, resource)), F.max(F.when(~is_app, resource)))


def _resources(role: str) -> list[Column]:
    return [_need(F.col(r), F.col(role) == "app").alias(r) for r in RESOURCES]


def _worst(rank: str) -> list[Column]:
    return [
        F.max(rank).alias("rank"),
        F.count(F.lit(1)).alias("children"),
        F.count_if(F.col(rank) > OK).alias("not_ok"),
    ]


def pod_resources(containers: DataFrame, keys: Sequence[str] = ("pod_uuid",), role: str = "role") -> DataFrame:
    """What a pod needs: the sum over its app containers, or one init/sidecar container if that is more.

    NULL if no container sets the resource.
    """
    return containers.groupBy(*keys).agg(*_resources(role))


def worst_state(children: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """Worst rank, number of children and number of children that are not ok, per parent."""
    return children.groupBy(*keys).agg(*_worst(rank))


def pod_summary(containers: DataFrame, keys: Sequence[str] = ("pod_uuid",)) -> DataFrame:
    """State and resources of pods in one aggregation."""
    return containers.groupBy(*keys).agg(*_worst("rank"), *_resources("role"))


def pod_resources_in_row(containers: Column, resource: str) -> Column:
    """The same over an array of containers with a ``role`` and the resource, without a shuffle."""

    def pick(keep: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(containers, lambda c: keep(c) & c[resource].isNotNull()), lambda c: c[resource])

    def total(amounts: Column) -> Column:
        # NULL if there is nothing to add up.
        return F.aggregate(
            amounts, F.lit(None).cast("bigint"), lambda acc, v: F.coalesce(acc, F.lit(0).cast("bigint")) + v
        )

    return F.greatest(total(pick(lambda c: c["role"] == "app")), F.array_max(pick(lambda c: c["role"] != "app")))


def last_match(children: DataFrame, keys: Sequence[str], order: Sequence[str], matches: Column, value: Column) -> DataFrame:
    """``value`` of the last child that matches, per parent (NULL if none does)."""
    position = F.struct(*[F.col(c) for c in order])
    return children.groupBy(*keys).agg(F.max_by(value, F.when(matches, position)).alias("value"))


def first_match(children: DataFrame, keys: Sequence[str], order: Sequence[str], matches: Column, value: Column) -> DataFrame:
    """``value`` of the first child that matches, per parent (NULL if none does)."""
    position = F.struct(*[F.col(c) for c in order])
    return children.groupBy(*keys).agg(F.min_by(value, F.when(matches, position)).alias("value"))


def access_modes(rows: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """Bit mask of the access modes listed in rows, per key; an empty mask is NULL."""
    return rows.groupBy(*keys).agg(
        F.nullif(F.bit_or(mode_bit(F.col(mode))), F.lit(0)).cast("smallint").alias("access_modes")
    )


def latest_row(rows: DataFrame, order: str, value: str) -> DataFrame:
    """``value`` of the row with the highest ``order`` over the whole table."""
    return rows.agg(F.max_by(value, order).alias(value))

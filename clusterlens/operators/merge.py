"""Table maintenance as pure functions: current rows + changes -> next rows.

Latest-wins uses ``max_by`` instead of a ranking window: it combines on the map side,
so a key with very many versions never has to be sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

DELETED = "DELETED"


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the highest ``order`` (compared column by column)."""
    payload = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*_columns(payload)), F.struct(*_columns(order))).alias("_row")
    )
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in payload]).select(*rows.columns)


def merge_latest(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keyed upsert of all columns, last writer wins."""
    return latest_per_key(current.unionByName(changes), keys, order)


def merge_partial(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]
) -> DataFrame:
    """Keyed upsert that inserts whole rows but updates only the ``update`` columns.

    ``changes`` holds one row per key (see :func:`latest_per_key`).
    """
    rest = [c for c in current.columns if c not in keys]
    old = current.select(*keys, F.struct(*_columns(rest)).alias("_old"))
    new = changes.select(*keys, F.struct(*_columns(rest)).alias("_new"))
    both = old.join(new, list(keys), "full_outer")

    def value(name: str) -> Column:
        first, second = ("_new", "_old") if name in update else ("_old", "_new")
        return F.when(F.col(first).isNotNull(), F.col(first)[name]).otherwise(F.col(second)[name]).alias(name)

    return both.select(*keys, *[value(c) for c in rest]).select(*current.columns)


def delete_keys(current: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``gone``; also used for children by foreign key."""
    keys = gone.select(F.col(gone_key or key).alias(key)).where(F.col(key).isNotNull())
    return current.join(keys, key, "left_anti")


def keep_keys(rows: DataFrame, keys: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose key is in ``keys`` (a key DataFrame, never a literal list)."""
    return rows.join(keys.select(F.col(other_key or key).alias(key)), key, "left_semi")


def apply_changes(
    current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op"
) -> DataFrame:
    """Replay a change log onto a table: per key the last change decides, deletes drop the row.

    ``current`` has the columns of ``changes`` without ``op``; its rows count as older than
    any change of the same ``order`` value.
    """
    base = current.withColumn(op, F.lit("UPDATED")).withColumn("_fresh", F.lit(0))
    merged = base.unionByName(changes.withColumn("_fresh", F.lit(1)))
    last = latest_per_key(merged, keys, [*order, "_fresh"])
    return last.where(F.col(op) != DELETED).drop(op, "_fresh")


def split_changes(changes: DataFrame, op: str = "op") -> tuple[DataFrame, DataFrame]:
    """(upserts, deletes); call it on changes that are already the latest per key."""
    return changes.where(F.col(op) != DELETED), changes.where(F.col(op) == DELETED)


def drop_vanishing(objects: DataFrame, now: Column, seconds: int = 30, column: str = "metadata.deletionTimestamp") -> DataFrame:
    """Drop upserts of objects that vanish within ``seconds``, so none lands after its delete."""
    limit = now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return objects.where(F.col(column).isNull() | (F.col(column) > limit))


def insert_only(current: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """Upsert that ignores deletes."""
    return merge_latest(current, changes.where(F.col(op) != DELETED).drop(op), keys, order)


def vanished(stored: DataFrame, listed: DataFrame, key: str = "uuid") -> DataFrame:
    """Keys that are stored but no longer listed (what a restart has to delete)."""
    return stored.select(key).join(listed.select(key), key, "left_anti")


def retain(rows: DataFrame, column: str, now: Column, days: int = 1) -> DataFrame:
    """Rows not older than ``days``."""
    return rows.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))


def replace_prefix(
    current: DataFrame,
    fresh: DataFrame,
    cluster: Column,
    prefix: str,
    keys: Sequence[str] = ("cluster_uuid", "key"),
) -> DataFrame:
    """Replace one cluster's locked settings below a prefix; rows of ``fresh`` win over kept ones."""
    replaced = (F.col("cluster_uuid") == cluster) & F.col("key").startswith(prefix) & F.col("locked")
    kept = current.where(~F.coalesce(replaced, F.lit(False))).join(fresh.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*current.columns))


def unused_entries(dictionary: DataFrame, bridge: DataFrame, bridge_key: str) -> DataFrame:
    """Dictionary rows (labels, annotations, selectors) no bridge row refers to."""
    return dictionary.join(bridge.select(F.col(bridge_key).alias("uuid")), "uuid", "left_anti")

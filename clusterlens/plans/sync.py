"""Keeping the tables of a kind in step with its objects.

One batch of changes to a kind is written in this order: rows of deleted objects' children,
deleted objects, objects, children.  Every write replaces what the same batch wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clusterlens.functions.ids import ensure_uuid
from clusterlens.operators.merge import drop_vanishing, vanished
from clusterlens.plans.common import Kind, Relation
from clusterlens.plans.registry import kinds
from clusterlens.schemas import object_schema
from clusterlens.sources.tables import FEW, LISTED, SEQ, KeyedTable, sized

_STAGE = "batch"

# Child tables of a batch are independent; this many are written at the same time.
CONCURRENT_WRITES = 8

# Tables no projection fills.
UNFILLED = {
    "favorite": "resource_uuid STRING, kind STRING, username STRING, priority INT",
    "service_pod": "service_uuid STRING, pod_uuid STRING",
    "container_log": "container_uuid STRING, pod_uuid STRING, logs STRING, last_update TIMESTAMP",
}


class Store:
    """The tables of some kinds under one folder."""

    def __init__(self, spark: SparkSession, root: str, names: Iterable[str]) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.kinds: dict[str, Kind] = {n: k for n, k in kinds().items() if n in set(names)}
        self.tables: dict[str, KeyedTable] = {}
        for kind in self.kinds.values():
            self._declare(kind)

    def _declare(self, kind: Kind) -> None:
        now = F.lit(None).cast("timestamp")
        empty = self.spark.createDataFrame([], f"{object_schema(kind.name)}, raw STRING")
        prepared = kind.prepared(empty, F.lit("").cast("string"), now)
        prepared = self.spark.createDataFrame([], prepared.schema)
        self._add(kind.name, ("uuid",), kind.table(kind.name, prepared, now).schema)
        for relation in _all(kind.relations):
            if relation.table in self.tables:
                continue
            if relation.build is not None:
                self._add(relation.table, relation.primary_key, relation.build(prepared).schema)
            elif relation.table in UNFILLED:
                schema = self.spark.createDataFrame([], UNFILLED[relation.table]).schema
                self._add(relation.table, relation.primary_key, schema)

    def _add(self, name: str, keys: tuple[str, ...], schema) -> None:
        self.tables[name] = KeyedTable(self.spark, f"{self.root}/{name}", schema, keys)

    def read(self, table: str, before: int | None = None, writer: str = "main") -> DataFrame:
        return self.tables[table].read(before, writer=writer)

    # ----------------------------------------------------------------- writes

    def upsert(
        self, kind: str, objects: DataFrame, cluster: Column, now: Column, batch: int, *, replace_children: bool = False
    ) -> DataFrame:
        """Upsert objects and their children; returns the parent rows written.

        Children that vanished from an object stay unless ``replace_children``.  The prepared
        objects are written once to a staging folder of the batch: every child table then reads
        only its own nested columns from there, and a lost executor costs no new parsing.
        Objects may carry a ``_seq``, the sequence number of their change, which their
        children get as well.
        """
        known = self.kinds[kind]
        staged = f"{self.root}/_staged/{kind}/{_STAGE}={batch}"
        known.prepared(objects, cluster, now).write.mode("overwrite").parquet(staged)
        prepared = self.spark.read.parquet(staged)
        ordered = [SEQ] if SEQ in prepared.columns else []
        if ordered:
            # A change may arrive after a newer delete: nothing would remove its children any more.
            late = self.tables[kind].deleted_since(sized(prepared.select("uuid", SEQ)))
            if not late.isEmpty():
                prepared.join(late, "uuid", "left_anti").select(prepared.columns).write.mode("overwrite").parquet(f"{staged}-live")
                prepared = self.spark.read.schema(prepared.schema).parquet(f"{staged}-live")
        parents = sized(prepared.select("uuid", *ordered))
        if replace_children:
            self._delete_children(known, parents, batch, own=False)
        own = known.table(kind, prepared, now)
        self.tables[kind].upsert(own.join(parents, "uuid") if ordered else own, batch, kind)
        relations = {r.table: (parent, r) for parent in known.relations for r in (parent, *parent.children)}

        def write(table: str) -> None:
            # One object may list a child key twice; as in a keyed upsert, the last one listed counts, which reading
            # decides. The rows of an object come from one row in one task, in the order listed.
            children = known.table(table, prepared, now).withColumn(LISTED, F.monotonically_increasing_id())
            parent, relation = relations[table]
            if ordered and relation.foreign_key in children.columns:
                above = parents
                if relation is not parent and parent.build is not None:
                    links = parent.build(prepared).select("uuid", F.col(parent.foreign_key).alias("_parent")).distinct()
                    above = links.join(parents.withColumnRenamed("uuid", "_parent"), "_parent").select("uuid", SEQ)
                above = above.groupBy("uuid").agg(F.max(SEQ).alias(SEQ)).withColumnRenamed("uuid", relation.foreign_key)
                children = children.join(above, relation.foreign_key, "left")
            # Without a parent of their own, entries of shared dictionaries never change.
            self.tables[table].upsert(children, batch, kind, 0 if ordered else None)

        _together(write, known.builders())
        written = self.tables[kind].batch(batch, kind)
        _remove(self.spark, staged)
        _remove(self.spark, f"{staged}-live")
        return written

    def delete(self, kind: str, gone: DataFrame, batch: int, writer: str = "") -> None:
        """Delete objects by ``uuid`` with everything that hangs on them; ``gone`` may have a ``_seq``."""
        some = gone.limit(FEW + 1).count()
        if not some:
            return  # most batches delete nothing; spare them the look at every child table
        known = self.kinds[kind]
        keys = gone.select("uuid", *[c for c in gone.columns if c == SEQ])
        self._delete_children(known, F.broadcast(keys) if some <= FEW else keys.hint("merge"), batch, own=True, writer=writer or kind)
        self.tables[kind].delete(gone, batch, writer or kind)

    def _delete_children(self, kind: Kind, gone: DataFrame, batch: int, *, own: bool, writer: str = "") -> None:
        """Delete the children of objects; ``own`` also those that are not derived from them."""
        found: dict[str, list[DataFrame]] = {}
        writer = writer or kind.name

        def collect(relations: Iterable[Relation], parents: DataFrame) -> None:
            for relation in relations:
                if not relation.cascade or relation.table not in self.tables:
                    continue
                if not own and relation.build is None and not relation.children:
                    continue
                table = self.tables[relation.table]
                foreign = parents.select(F.col("uuid").alias(relation.foreign_key), *[c for c in parents.columns if c == SEQ])
                doomed = table.keys_of(foreign, relation.foreign_key, batch, writer)
                found.setdefault(relation.table, []).append(doomed)
                if relation.children:
                    collect(relation.children, sized(doomed))

        collect(kind.relations, gone)
        def write(name: str) -> None:
            self.tables[name].delete(reduce(DataFrame.unionByName, found[name]).distinct(), batch, writer)

        _together(write, found)

    def reconcile(self, kind: str, listed: DataFrame, cluster: Column, batch: int, seq: int | None = None) -> DataFrame:
        """Delete a cluster's stored objects that are not listed any more; returns their keys.

        ``seq`` is the sequence number of the listing: what changed after it stays.  The
        deletes are those of a writer of its own, so no batch of the stream replaces them.
        """
        writer = f"{kind}-listing"
        stored = self.tables[kind].keys_where(F.col("cluster_uuid") == cluster, batch, writer)
        # A listing is as large as what is stored: its keys are never broadcast.
        gone = vanished(stored, objects_keys(listed).hint("merge"))
        self.delete(kind, gone.withColumn(SEQ, F.lit(batch if seq is None else seq).cast("bigint")), batch, writer)
        return gone


@contextmanager
def staged(store: Store, changes: DataFrame, kind: str, batch: int) -> Iterator[DataFrame]:
    """The change records of a batch, read from a staging folder that goes with the context."""
    folder = f"{store.root}/_staged/{kind}-changes/{_STAGE}={batch}"
    changes.write.mode("overwrite").parquet(folder)
    try:
        yield store.spark.read.schema(changes.schema).parquet(folder)
    finally:
        _remove(store.spark, folder)


def _together(task: Callable[[str], None], names: Iterable[str]) -> None:
    """Run independent table writes as concurrent Spark jobs; the first error is raised."""
    with ThreadPoolExecutor(max_workers=CONCURRENT_WRITES) as pool:
        list(pool.map(task, list(names)))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def objects_keys(objects: DataFrame) -> DataFrame:
    return objects.select(ensure_uuid(F.col("metadata.uid")).alias("uuid"))


def _all(relations: Iterable[Relation]) -> list[Relation]:
    return [r for parent in relations for r in (parent, *parent.children)]


def coalesced(changes: DataFrame) -> DataFrame:
    """The last change per object of a batch, and whether the batch deletes the object.

    ``changes``: ``change_uuid``, ``seq`` and the still unparsed ``raw`` document, so versions
    in between are dropped before anything is parsed.  An object that is deleted and added
    again within the batch is both deleted and upserted.
    """
    payload = F.struct(*[F.col(c) for c in changes.columns if c != "change_uuid"])
    grouped = changes.groupBy("change_uuid").agg(
        F.max_by(payload, "seq").alias("last"), F.bool_or(is_delete()).alias("deleted")
    )
    return grouped.select("change_uuid", "deleted", "last.*")


def is_delete() -> Column:
    """A change without an object is a delete, whatever it says."""
    return (F.col("op") == "DELETED") | F.col("raw").isNull()


def guarded(objects: DataFrame, now: Column) -> DataFrame:
    return drop_vanishing(objects, now)

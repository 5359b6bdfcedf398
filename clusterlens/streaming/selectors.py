"""The relation of services and pods, kept by batches of changes through an inverted index.

The index is plain Parquet, one folder per batch and in it one per bucket:

- ``postings``: label entries of pods, by bucket of the entry,
- ``anchors``: each different selector under its rarest entry when it first came, by bucket of that entry,
- ``pods`` and ``services``: what they looked like, by bucket of their key,
- ``pairs``: which selector covers which version of a pod.

A batch of pods looks up the anchors in the buckets of its own entries, a batch of services the postings in those of its
selectors; neither reads the other side's objects or counts labels of the whole cluster.  Equal selectors are matched and
stored once, whichever services and versions of them carry one; reading gives their pods to the services.  A pair counts as
long as its pod's version is the current one and a service's current version carries its selector, so changes and deletes
need no look at older pairs, and batches may arrive in any order.
Every batch writes what it knows before it looks anything up: of a pod and a service that arrive in two streams at the same
time at least one sees the other.  Writing a batch again replaces its folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from clusterlens.functions.ids import ensure_uuid
from clusterlens.operators.merge import latest_per_key
from clusterlens.plans import sync
from clusterlens.plans.layout import drop_folder, exists
from clusterlens.session import scratch_dir
from clusterlens.sources.readers import parse_objects

_SCOPE = ["cluster_uuid", "namespace"]
_ENTRY = "STRUCT<key: STRING, value: STRING>"
_TABLES = {
    "pods": "cluster_uuid STRING, namespace STRING, uuid STRING, labels MAP<STRING, STRING>, seq BIGINT, gone BOOLEAN",
    "services": "cluster_uuid STRING, namespace STRING, uuid STRING, selector MAP<STRING, STRING>, seq BIGINT, gone BOOLEAN",
    "postings": f"cluster_uuid STRING, namespace STRING, entry {_ENTRY}, uuid STRING, seq BIGINT",
    "anchors": f"cluster_uuid STRING, namespace STRING, entry {_ENTRY}, terms ARRAY<{_ENTRY}>, wanted BINARY",
    "pairs": "wanted BINARY, pod_uuid STRING, pod_seq BIGINT",
}


def _selectors(services: DataFrame) -> DataFrame:
    """Versions of services that select something, with the entries of the selector and ``wanted``, which stands for them and their scope."""
    terms = F.sort_array(F.map_entries("selector"))
    chosen = services.where("NOT gone").where(F.size("selector") > 0).select(*_SCOPE, "uuid", "seq", terms.alias("terms"))
    return chosen.withColumn("wanted", F.unhex(F.md5(F.to_json(F.struct(*_SCOPE, "terms")))))


class SelectorIndex:
    """Services and the pods they select, as far as the batches given so far tell.

    ``buckets``: folders per table and batch; a batch opens those of its entries only.
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 32, same_namespace: bool = True) -> None:
        self.spark, self.root, self.buckets, self.same_namespace = spark, root.rstrip("/"), buckets, same_namespace

    # ----------------------------------------------------------------- changes

    def pods_changed(self, rows: DataFrame, number: int) -> None:
        """``cluster_uuid, uuid, namespace, labels, seq, gone``: the last change of each pod of a batch."""
        self._write("pods", self._scoped(rows, "labels"), number, "uuid")
        pods = self._batch("pods", number).where("NOT gone")
        entries = pods.select(*_SCOPE, F.explode(F.map_entries("labels")).alias("entry"), "uuid", "seq")
        self._write("postings", entries, number, "entry")
        met = self._met(self._batch("postings", number), self._read("anchors", self._batch("postings", number)))
        self._pair(met, pods, number, "pods")

    def services_changed(self, rows: DataFrame, number: int) -> None:
        """``cluster_uuid, uuid, namespace, selector, seq, gone``: the last change of each service of a batch."""
        self._write("services", self._scoped(rows, "selector"), number, "uuid")
        terms = _selectors(self._batch("services", number)).select(*_SCOPE, "terms", "wanted").distinct()
        terms = terms.withColumn("entry", F.explode("terms")).withColumn("bucket", self._bucket("entry"))
        # A selector that an earlier batch brought has met the pods before it, and those after it have met its anchor.
        known = self._read("anchors", terms).where(F.col("batch") != number).select("wanted")
        terms = terms.join(known, "wanted", "left_anti")
        on = [*_SCOPE, "bucket", "entry"]
        carriers = self._read("postings", terms).groupBy(*on).count()
        rarest = F.min_by("entry", F.struct(F.coalesce("count", F.lit(0)), F.col("entry")))
        anchors = terms.join(carriers, on, "left").groupBy(*_SCOPE, "terms", "wanted").agg(rarest.alias("entry"))
        self._write("anchors", anchors, number, "entry")
        anchors = self._batch("anchors", number)
        folder = scratch_dir(self.spark, "candidates")
        met = self._met(self._read("postings", anchors), anchors).withColumn("bucket", self._bucket("pod_uuid"))
        met.write.parquet(folder)
        met = self.spark.read.schema(met.schema).parquet(folder)
        self._pair(met.drop("bucket"), self._read("pods", met), number, "services")
        drop_folder(self.spark, folder)

    @staticmethod
    def _met(postings: DataFrame, anchors: DataFrame) -> DataFrame:
        """Versions of pods that carry the anchor of a selector."""
        mine = anchors.select(*_SCOPE, "bucket", "entry", "terms", "wanted")
        found = postings.join(mine, [*_SCOPE, "bucket", "entry"])
        return found.select("wanted", "terms", F.col("uuid").alias("pod_uuid"), F.col("seq").alias("pod_seq"))

    def _pair(self, met: DataFrame, pods: DataFrame, number: int, side: str) -> None:
        labels = pods.select(F.col("uuid").alias("pod_uuid"), F.col("seq").alias("pod_seq"), "labels")
        covered = F.forall("terms", lambda x: F.coalesce(F.element_at("labels", x["key"]) == x["value"], F.lit(False)))
        pairs = met.join(labels, ["pod_uuid", "pod_seq"]).where(covered).select("wanted", "pod_uuid", "pod_seq").distinct()
        pairs.write.mode("overwrite").parquet(f"{self.root}/pairs/batch={number}/side={side}")

    # ----------------------------------------------------------------- the relation

    def read(self) -> DataFrame:
        """``service_uuid, pod_uuid``: what the current services select of the current pods."""

        def current(table: str, name: str) -> DataFrame:
            # At equal numbers an upsert wins over a delete.
            last = self._read(table).groupBy(F.col("uuid").alias(f"{name}_uuid")).agg(F.max(F.struct("seq", ~F.col("gone"))).alias("last"))
            return last.where("last.col2").select(f"{name}_uuid", F.col("last.seq").alias(f"{name}_seq"))

        pairs = self._read("pairs").select("wanted", "pod_uuid", "pod_seq")
        pairs = pairs.join(current("pods", "pod"), ["pod_uuid", "pod_seq"], "left_semi").select("wanted", "pod_uuid")
        services = _selectors(self._read("services")).select(F.col("uuid").alias("service_uuid"), F.col("seq").alias("service_seq"), "wanted")
        services = services.join(current("services", "service"), ["service_uuid", "service_seq"], "left_semi").select("service_uuid", "wanted")
        return pairs.join(services.distinct(), "wanted").select("service_uuid", "pod_uuid").distinct()

    def folded(self, target: str) -> "SelectorIndex":
        """An index of the last versions only, with anchors chosen anew; streams go on with it under their own batch numbers.

        Deletes are kept, since older changes may still arrive.  Entries that were rare when their selector came may be frequent by now, so
        fold when there are many batches or the cluster has changed much.
        """
        fresh = SelectorIndex(self.spark, target, buckets=self.buckets, same_namespace=self.same_namespace)
        for table, change in (("pods", fresh.pods_changed), ("services", fresh.services_changed)):
            change(latest_per_key(self._read(table).withColumn("alive", ~F.col("gone")), ["uuid"], ["seq", "alive"]), -1)
        return fresh

    # ----------------------------------------------------------------- files

    def _scoped(self, rows: DataFrame, entries: str) -> DataFrame:
        namespace = F.coalesce("namespace", F.lit("")) if self.same_namespace else F.lit("")
        return rows.select(F.coalesce("cluster_uuid", F.lit("")).alias("cluster_uuid"), namespace.alias("namespace"), "uuid", entries, "seq", "gone")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, number: int, key: str) -> None:
        writer = rows.withColumn("bucket", self._bucket(key)).write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("bucket").parquet(f"{self.root}/{table}/batch={number}")

    def _batch(self, table: str, number: int) -> DataFrame:
        return self.spark.read.schema(f"{_TABLES[table]}, bucket INT").parquet(f"{self.root}/{table}/batch={number}")

    def _read(self, table: str, met: DataFrame | None = None) -> DataFrame:
        """All batches of a table, or of it the buckets that occur in ``met`` (the driver sees bucket numbers only)."""
        schema = f"{_TABLES[table]}, batch BIGINT, " + ("side STRING" if table == "pairs" else "bucket INT")
        path = f"{self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", path).parquet(path)
        if met is None:
            return rows
        return rows.where(F.col("bucket").isin([r.bucket for r in met.select("bucket").distinct().collect()]))


def service_pods(changes: DataFrame, index: SelectorIndex) -> DataStreamWriter:
    """Keep an index in step with a stream of change records of pods and services."""

    def apply(batch: DataFrame, number: int) -> None:
        kinds = (("pod", "metadata.labels", "labels", index.pods_changed), ("service", "spec.selector", "selector", index.services_changed))
        for kind, path, name, consume in kinds:
            mine = batch.where(F.col("kind") == kind).withColumn("change_uuid", ensure_uuid(F.col("uid")))
            last = sync.coalesced(mine.withColumnRenamed("object", "raw"))
            slim = last.select(F.col("change_uuid").alias("uuid"), "seq", "cluster_uuid", sync.is_delete().alias("gone"), "raw")
            objects = parse_objects(slim, kind)
            consume(objects.select("cluster_uuid", "uuid", F.col("metadata.namespace").alias("namespace"), F.col(path).alias(name), "seq", "gone"), number)

    return changes.writeStream.foreachBatch(apply)

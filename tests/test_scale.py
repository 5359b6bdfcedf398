"""What joins and jobs may not do as their input grows."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from clusterlens.operators import metrics, relate
from clusterlens.plans import catalog
from clusterlens.plans.registry import kinds
from clusterlens.plans.sync import Store
from clusterlens.sources import tables
from clusterlens.sources.readers import parse_objects
from clusterlens.streaming import polling


def _plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_many_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Keys of wide rows look small to the optimiser, however many they are."""
    wide = spark.range(200).select(F.col("id").cast("string").alias("k"), *[F.lit("x").alias(f"c{n}") for n in range(50)])
    wide.write.parquet(f"{tmp_path}/wide")
    keys = spark.read.parquet(f"{tmp_path}/wide").select("k")
    table = tables.KeyedTable(spark, f"{tmp_path}/table", spark.createDataFrame([], "k STRING, v BIGINT").schema, ["k"])
    table.upsert(spark.range(300).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")), 0)
    few = table.read(1, only=keys)
    monkeypatch.setattr(tables, "FEW", 100)
    many = table.read(1, only=keys)
    assert "BroadcastHashJoin" in _plan(few)
    assert "Broadcast" not in _plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    assert many.count() == 200


@pytest.mark.parametrize("limit", [0, 1000])
def test_children_and_deletes_of_a_large_batch(spark, tmp_path, monkeypatch, limit):
    """Small and large changes leave the same rows; a listing and a delete leave no child behind."""
    monkeypatch.setattr(tables, "FEW", limit)
    monkeypatch.setattr("clusterlens.plans.sync.FEW", limit)
    store = Store(spark, f"{tmp_path}/{limit}", ["service"])

    def objects(low: int, high: int, seq: int):
        raw = F.format_string('{"metadata": {"uid": "s%1$d", "name": "s%1$d"}, "spec": {"ports": [{"name": "a", "port": 1}]}}', "id")
        return parse_objects(spark.range(low, high).select(raw.alias("raw"), F.lit(seq).cast("bigint").alias("_seq")), "service")

    now, cluster = F.lit("2024-02-01").cast("timestamp"), F.lit("c1")
    store.upsert("service", objects(0, 30, 1), cluster, now, 0)
    store.reconcile("service", objects(0, 20, 2), cluster, 1, seq=2)
    gone = store.read("service").where("name IN ('s1', 's2')").select("uuid", F.lit(3).cast("bigint").alias("_seq"))
    store.delete("service", gone, 2)
    assert sorted(r.name for r in store.read("service").collect()) == sorted(f"s{n}" for n in range(20) if n not in (1, 2))
    assert store.read("service_port").count() == 18


def test_stored_keys_are_not_broadcast_for_a_small_change(spark, tmp_path, monkeypatch):
    """Tombstones of a wide table look smaller to the optimiser than a few objects with long documents, however many they are."""
    schema = spark.createDataFrame([], "k STRING, " + ", ".join(f"c{n} STRING" for n in range(40))).schema
    table = tables.KeyedTable(spark, f"{tmp_path}/table", schema, ["k"])
    table.delete(spark.range(3000).select(F.col("id").cast("string").alias("k")), 0, seq=5)
    long = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(n)), 512) for n in range(80)])
    spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10).alias("_seq"), long.alias("raw")).write.parquet(f"{tmp_path}/change")
    change = spark.read.parquet(f"{tmp_path}/change").select("k", "_seq")
    small = table.deleted_since(tables.sized(change))
    assert "BuildLeft" in _plan(small) and "BuildRight" not in _plan(small)
    monkeypatch.setattr(tables, "FEW", 10)
    large = table.deleted_since(tables.sized(change))
    assert "Broadcast" not in _plan(large)
    assert sorted(r.k for r in small.collect()) == sorted(r.k for r in large.collect()) == sorted(str(n) for n in range(50) if n % 10 < 5)


@pytest.mark.parametrize("limit", [0, 1000])
def test_grandchildren_are_not_broadcast_for_a_delete(spark, tmp_path, monkeypatch, limit):
    """What is stored of the children of deleted objects' children is not sent through the driver either."""
    monkeypatch.setattr(tables, "FEW", limit)
    monkeypatch.setattr("clusterlens.plans.sync.FEW", limit)
    store = Store(spark, f"{tmp_path}/tables", ["pod"])
    document = """{"metadata": {"uid": "p%1$d", "name": "p%1$d"}, "spec": {"containers": [{"name": "a", "volumeMounts": [{"name": "v", "mountPath": "/v"}]}]}}"""
    pods = spark.range(30).select(F.format_string(document, "id").alias("raw"), F.lit(1).cast("bigint").alias("_seq"))
    store.upsert("pod", parse_objects(pods, "pod"), F.lit("c1"), F.lit("2024-02-01").cast("timestamp"), 0)
    plans, delete = {}, tables.KeyedTable.delete

    def recorded(self, keys, *rest, **named):
        plans[self.path.rpartition("/")[2]] = _plan(keys)
        delete(self, keys, *rest, **named)

    monkeypatch.setattr(tables.KeyedTable, "delete", recorded)
    gone = store.read("pod").where("name < 'p2'").select("uuid", F.lit(3).cast("bigint").alias("_seq"))
    store.delete("pod", gone, 2)
    assert "container_mount" in plans
    assert all("BuildLeft" not in plan for plan in plans.values())  # the stored rows are on the left
    assert ("SortMergeJoin" in plans["container_mount"]) == (limit == 0)
    left = sorted(r.name for r in store.read("pod").collect())
    assert left == sorted(f"p{n}" for n in range(30) if not f"p{n}" < "p2")
    assert store.read("container").count() == store.read("container_mount").count() == len(left)


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_of_a_large_batch_are_not_broadcast(spark, tmp_path, monkeypatch, limit):
    """Neither the objects of a batch nor their children are written through a broadcast, unless the batch is small."""
    monkeypatch.setattr(tables, "FEW", limit)
    monkeypatch.setattr("clusterlens.plans.sync.FEW", limit)
    store = Store(spark, f"{tmp_path}/tables", ["namespace"])
    document = """{"metadata": {"uid": "n%1$d", "name": "n%1$d", "labels": {"a": "%1$d"}}}"""
    objects = spark.range(40).select(F.format_string(document, "id").alias("raw"), F.col("id").alias("_seq"))
    plans, upsert = {}, tables.KeyedTable.upsert

    def recorded(self, rows, *rest, **named):
        plans[self.path.rpartition("/")[2]] = _plan(rows)
        upsert(self, rows, *rest, **named)

    monkeypatch.setattr(tables.KeyedTable, "upsert", recorded)
    store.upsert("namespace", parse_objects(objects, "namespace"), F.lit("c1"), F.lit("2024-02-01").cast("timestamp"), 0)
    assert {"namespace", "namespace_label"} <= set(plans)
    assert "BuildLeft" not in "".join(plans.values())
    for table in ("namespace", "namespace_label"):
        assert ("BuildRight" in plans[table]) == (limit > 0)
        assert store.read(table).count() == 40


@pytest.mark.parametrize("step", [60_000, 30_000])
def test_allocations_share_their_joins(spark, step):
    """All allocation metrics of a level go through one aggregation and its joins, with the rows that each has by itself."""
    samples = []
    for n in range(60):
        labels = {"resource": ("cpu", "memory", "disk")[n % 3], "node": f"n{n % 2}" if n % 7 else "", "namespace": "a", "pod": f"p{n % 5}", "container": f"c{n % 4}"}
        for metric, factor in ((catalog.REQUESTS, 1), (catalog.LIMITS, 2)):
            if (n + factor) % 9:
                samples.append((metric, labels, n * 11, float("nan") if n == 31 else float(factor * n)))
        samples.append((catalog.NODE_CORES, {"node": f"n{n % 2}"}, n * 11, float(n % 4)))
        if n % 2:
            samples.append((catalog.NODE_MEMORY, {"node": "n1"}, n * 11, 100.0))
    rows = spark.createDataFrame(samples, "metric STRING, labels MAP<STRING, STRING>, s BIGINT, value DOUBLE")
    rows = rows.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    pods = spark.createDataFrame([("a", f"p{n}", f"00000000-0000-0000-0000-00000000000{n}") for n in range(4)], "namespace STRING, pod STRING, pod_uuid STRING")
    nodes = spark.createDataFrame([("n0", "u0"), ("n1", "u1")], "node STRING, node_uuid STRING")
    grid = {"step": step}
    levels = [(catalog.CONTAINER, {"pods": pods}), (catalog.POD, {"pods": pods}), (catalog.NODE, {"nodes": nodes})]
    for level, lookups in levels[: 3 if step == 60_000 else 1]:
        def found(frame):
            kept = frame.where("category LIKE '%request%' OR category LIKE '%limit%'")
            return sorted((r.entity_uuid, r.timestamp, r.category, r.name, round(r.value, 9)) for r in kept.collect())

        entries = [e for e in catalog.catalog().values() if e.level == level and e.category.split(".")[1] in ("request", "limit")]
        assert len(entries) == 8
        alone = [catalog.metric_rows(e, catalog.vector(e, rows, **grid), **lookups) for e in entries]
        wanted = found(reduce(DataFrame.unionByName, alone))
        whole = catalog.level_rows(level, rows, grid=grid, **lookups)
        assert wanted and found(whole) == wanted
        if level == catalog.POD:
            assert found(catalog.level_rows(level, catalog.Shared(rows), grid=grid, **lookups)) == wanted
        if level == catalog.CONTAINER:
            assert _plan(whole).count("Exchange hashpartitioning") <= 8


def test_labels_of_all_pods_are_not_broadcast(spark, tmp_path):
    """Files of labels look small; candidates that cannot be covered are left out before labels are looked at."""
    labels = F.create_map(F.lit("tier"), F.lit("shop"), F.lit("app"), F.format_string("a%d", F.col("id") % 50))
    spark.range(1000).select(F.col("id").alias("pod_uuid"), F.lit("n").alias("namespace"), labels.alias("labels")).write.parquet(f"{tmp_path}/pods")
    pods = spark.read.parquet(f"{tmp_path}/pods")
    selector = F.create_map(F.lit("tier"), F.lit("shop"), F.lit("app"), F.format_string("a%d", "id"))
    services = spark.range(3).select(F.col("id").alias("service_uuid"), F.lit("n").alias("namespace"), selector.alias("selector"))
    found = relate.select_pods(services, pods)
    assert sorted(map(tuple, found.collect())) == [(s, p) for s in range(3) for p in range(s, 1000, 50)]
    lines = _plan(found).split("\n")
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    sent = [n for n, line in enumerate(lines) if "BroadcastExchange" in line]
    below = [lines[k] for n in sent for k in range(n + 1, next((k for k in range(n + 1, len(lines)) if depth[k] <= depth[n]), len(lines)))]
    assert below and not [line for line in below if "pod_uuid" in line]


def test_repeated_samples_need_no_shuffle_of_their_own(spark, tmp_path):
    """Samples that several batches delivered count once, where the samples of a series meet anyway."""
    rows = [("a", {"x": str(n % 2)}, n * 13, None if n == 9 else float(n % 7)) for n in range(40)]
    samples = spark.createDataFrame(rows, "metric STRING, labels MAP<STRING, STRING>, s BIGINT, value DOUBLE").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    states = polling.StepStates(spark, f"{tmp_path}/states")
    for number in range(2):
        states.add(samples, number)
    again = states.samples([0], once=False)
    assert again.count() == 80 and states.samples([0]).count() == 40 and "Exchange" not in _plan(again)

    def found(vector):
        return sorted((r.tick, r.value) for r in vector.where("value IS NOT NULL").collect())

    assert found(metrics.rate(again, "a", 120_000, repeated=True)) == found(metrics.rate(samples, "a", 120_000))
    assert found(metrics.instant(again, "a", repeated=True)) == found(metrics.instant(samples, "a"))


def test_devices_need_no_verdict(spark):
    """What the specs of containers list is read without the health of the containers, in the same order as they are stored."""
    raw = """{"metadata": {"uid": "p"}, "spec": {
      "initContainers": [{"name": "proxy", "restartPolicy": "Always", "volumeDevices": [{"name": "d", "devicePath": "/p"}]},
        {"name": "setup", "volumeDevices": [{"name": "d", "devicePath": "/s"}]}],
      "containers": [{"name": "main", "volumeDevices": [{"name": "d", "devicePath": "/m"}, {"name": "e", "devicePath": "/n"}]}, {"name": "bare"}]}}"""
    pod, now = kinds()["pod"], F.lit("2024-02-01").cast("timestamp")
    prepared = pod.prepared(parse_objects(spark.createDataFrame([(raw,)], "raw STRING"), "pod"), F.lit("c1"), now)
    found = pod.table("container_device", prepared, now)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        assert "terminated successfully" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [r.path for r in found.collect()] == ["/s", "/p", "/m", "/n"]

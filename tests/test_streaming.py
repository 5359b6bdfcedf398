"""Streaming jobs: replayed in any number of files they leave what one batch leaves."""

import json

import pytest
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.plans.sync import Store
from clusterlens.sources.readers import parse_objects, read_changes, read_log_chunks, read_log_lines
from clusterlens.sources.tables import KeyedTable
from clusterlens.streaming import jobs

NOW = "2024-01-02 00:00:00"


def clock():
    return F.lit(NOW).cast("timestamp")


def pod(uid, version, containers=("main",), **meta):
    return {
        "metadata": {
            "uid": uid,
            "name": f"pod-{uid}",
            "namespace": "shop",
            "resourceVersion": str(version),
            "creationTimestamp": "2024-01-01T00:00:00Z",
            "labels": {"app": "web", "v": str(version)},
            **meta,
        },
        "spec": {"containers": [{"name": c, "image": "i", "volumeMounts": [{"name": "d", "mountPath": "/d"}]} for c in containers]},
        "status": {"phase": "Running", "containerStatuses": [{"name": c, "ready": True, "started": True, "state": {"running": {"startedAt": "2024-01-01T00:00:00Z"}}} for c in containers]},
    }


def change(op, seq, uid, obj=None, kind="pod"):
    return json.dumps(
        {"op": op, "seq": seq, "kind": kind, "uid": uid, "key": f"shop/{uid}", "object": json.dumps(obj) if obj else None, "cluster_uuid": "c1"}
    )


def space(uid, version, **meta):
    return {"metadata": pod(uid, version, **meta)["metadata"], "status": {"phase": "Active"}}


LOG = [
    change("ADDED", 1, "a", space("a", 1), "namespace"),
    change("ADDED", 2, "b", space("b", 1), "namespace"),
    change("UPDATED", 3, "a", space("a", 2), "namespace"),
    change("ADDED", 4, "c", space("c", 1), "namespace"),
    change("DELETED", 5, "b", space("b", 1), "namespace"),
    change("UPDATED", 6, "c", space("c", 2, deletionTimestamp="2024-01-02T00:00:10Z"), "namespace"),
    change("DELETED", 7, "a", None, "namespace"),
    change("ADDED", 8, "a", space("a", 3), "namespace"),
    change("ADDED", 9, "x", pod("x", 1), kind="node"),
]


def replay(spark, folder, log, parts, store, kind="namespace", **options):
    source = folder / "in"
    source.mkdir()
    size = -(-len(log) // parts)
    for number in range(parts):
        (source / f"{number}.json").write_text("\n".join(log[number * size : (number + 1) * size]))
        query = (
            jobs.object_changes(read_changes(spark, str(source), maxFilesPerTrigger="1"), store, kind, clock=clock, **options)
            .option("checkpointLocation", str(folder / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("parts", [1, 3])
def test_changes_leave_the_same_tables(spark, tmp_path, parts):
    store = Store(spark, str(tmp_path / "tables"), ["namespace"])
    replay(spark, tmp_path, LOG, parts, store)
    # The last version of c vanishes within the guard time, and its batch never sees an earlier one.
    assert rows(store.read("namespace"), "uid", "resource_version") == [("a", "3")]
    live = {u for (u,) in rows(store.read("namespace"), "uuid")}
    assert {u for (u,) in rows(store.read("namespace_label"), "namespace_uuid")} == live
    # The delete before version 3 took the labels of earlier versions along.
    assert len(rows(store.read("namespace_label"), "label_uuid")) == 2

    # The same batch written again changes nothing; a restart deletes what is not listed.
    before = rows(store.read("namespace_label"), "namespace_uuid", "label_uuid")
    again = parse_objects(spark.createDataFrame([(json.dumps(space("a", 3)),)], "raw STRING"), "namespace")
    for _ in range(2):
        store.upsert("namespace", again, F.lit("c1"), clock(), 20)
    assert rows(store.read("namespace_label"), "namespace_uuid", "label_uuid") == before
    store.upsert("namespace", parse_objects(spark.createDataFrame([(json.dumps(space("d", 1)),)], "raw STRING"), "namespace"), F.lit("c1"), clock(), 21)
    assert rows(store.reconcile("namespace", again, F.lit("c1"), 22), "uuid") != []
    assert rows(store.read("namespace"), "uid") == [("a",)]
    assert store.tables["namespace"].compact(str(tmp_path / "compacted")).read().count() == 1


def test_children_are_kept_or_replaced(spark, tmp_path):
    first, second = (parse_objects(spark.createDataFrame([(json.dumps(p),)], "raw STRING"), "pod") for p in (pod("a", 1, ("main", "old")), pod("a", 2, ("main",))))
    store = Store(spark, str(tmp_path / "tables"), ["pod"])
    store.upsert("pod", first, F.lit("c1"), clock(), 0)
    store.upsert("pod", second, F.lit("c1"), clock(), 1)
    assert rows(store.read("container"), "name") == [("main",), ("old",)]
    store.upsert("pod", second, F.lit("c1"), clock(), 2, replace_children=True)
    assert rows(store.read("container"), "name") == [("main",)]
    store.delete("pod", store.read("pod"), 3)
    left = {name: table.read().count() for name, table in store.tables.items()}
    # Only the shared dictionaries outlive the pod.
    assert {name for name, count in left.items() if count} == {"label"}


def test_consumers_see_written_rows_and_service_pods_follow(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), ["pod", "service"])
    services = spark.createDataFrame([("s1", "shop", {"app": "web"}), ("s2", "shop", {"app": "db"})], "service_uuid STRING, namespace STRING, selector MAP<STRING, STRING>")

    def pods():
        labels = store.read("pod_label").join(store.read("label"), F.col("uuid") == F.col("label_uuid"))
        maps = labels.groupBy("pod_uuid").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("labels"))
        return maps.join(store.read("pod").select(F.col("uuid").alias("pod_uuid"), "namespace"), "pod_uuid")

    on_pods, _, on_deletes = jobs.service_pods(store, lambda: services, pods)
    sent = KeyedTable(spark, str(tmp_path / "sent"), spark.createDataFrame([], "uuid STRING, severity STRING, message STRING").schema, ["uuid"])
    notifier = jobs.health_notifications("pod", jobs.json_sink(str(tmp_path / "events")), sent=sent)
    replay(spark, tmp_path, [change("ADDED", 1, "a", pod("a", 1)), change("ADDED", 2, "b", pod("b", 1)), change("UPDATED", 3, "a", pod("a", 1)), change("DELETED", 4, "b")], 2, store, "pod",
           on_upsert=[on_pods, notifier], on_delete=[on_deletes])
    live = {u for (u,) in rows(store.read("pod"), "uuid")}
    assert {(s, p) for s, p in rows(store.read("service_pod"), "service_uuid", "pod_uuid")} == {("s1", p) for p in live}
    events = spark.read.json(str(tmp_path / "events"))
    # The second batch repeats the state of a, so it sends nothing.
    assert events.count() == 2


def test_minutes_overwrite(spark, tmp_path):
    source = tmp_path / "in"
    schema = "key STRING, ts TIMESTAMP, value DOUBLE"
    table = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "key STRING, minute TIMESTAMP, ts TIMESTAMP, value DOUBLE").schema, ["key", "minute"])
    data = [[("a", "2024-01-01 00:00:10", 1.0), ("a", "2024-01-01 00:00:50", 2.0)], [("a", "2024-01-01 00:00:30", 3.0), ("a", "2024-01-01 00:01:30", 4.0), ("b", "2024-01-01 00:01:00", float("nan"))]]
    for part in data:
        frame = spark.createDataFrame(part, "key STRING, ts STRING, value DOUBLE").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.metric_minutes(stream, table, ["key"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r[2] for r in rows(table.read(), "key", "minute", "value")] == [2.0, 4.0]
    windows = jobs.minute_windows(spark.read.schema(schema).parquet(str(source)), ["key"])
    assert [r[2] for r in rows(windows, "key", "minute", "value")] == [2.0, 4.0]


def test_logs_are_appended_for_started_containers(spark, tmp_path):
    schema = spark.createDataFrame([], "container_uuid STRING, pod_uuid STRING, logs STRING, last_update TIMESTAMP").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["container_uuid"])
    containers = spark.createDataFrame([("c1", True), ("c2", False)], "uuid STRING, started BOOLEAN")
    source = tmp_path / "in"
    for seq, text in enumerate(["one\n", "two\n"]):
        chunks = [("c1", "p", seq, text), ("c2", "p", seq, text)]
        frame = spark.createDataFrame(chunks, "container_uuid STRING, pod_uuid STRING, seq BIGINT, text STRING").withColumn("ts", clock())
        frame.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schemas.LOG_CHUNK).parquet(str(source))
        jobs.log_appends(stream, table, lambda: containers).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(table.read(), "container_uuid", "logs") == [("c1", "one\ntwo\n")]


def test_log_files_are_read_by_path(spark, tmp_path):
    folder = tmp_path / "in" / "pod_uuid=p1" / "container_uuid=c1"
    folder.mkdir(parents=True)
    (folder / "7.log").write_text("a\nb\n")
    read_log_chunks(spark, str(tmp_path / "in" / "*" / "*")).writeStream.format("memory").queryName("chunks").option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r)[:4] for r in spark.table("chunks").collect()] == [("c1", "p1", 7, "a\nb\n")]


def test_log_files_of_many_splits_keep_their_order(spark, tmp_path):
    schema = spark.createDataFrame([], "container_uuid STRING, pod_uuid STRING, logs STRING, last_update TIMESTAMP").schema
    table = KeyedTable(spark, str(tmp_path / "t"), schema, ["container_uuid"])
    containers = spark.createDataFrame([("c1", True), ("c2", False), ("c3", True)], "uuid STRING, started BOOLEAN")
    wanted = {"c1": "", "c3": ""}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        for batch, numbers in enumerate([(10, 9), (11,)]):
            for container in ("c1", "c2", "c3"):
                folder = tmp_path / "in" / "pod_uuid=p1" / f"container_uuid={container}"
                folder.mkdir(parents=True, exist_ok=True)
                for seq in numbers:
                    # Lines of many lengths, empty ones, carriage returns; file 9 breaks off inside a line.
                    text = "".join(f"{container} {seq} {n} " + "é" * (n * 37 % 90) + ("\r\n" if n % 5 else "\n\n") for n in range(60))
                    (folder / f"{seq}.log").write_bytes((text + ("begun " if seq == 9 else "")).encode())
                for seq in sorted(numbers):
                    if container in wanted:
                        wanted[container] += (folder / f"{seq}.log").read_bytes().decode()
            lines = read_log_lines(spark, str(tmp_path / "in" / "*" / "*"))
            jobs.log_file_appends(lines, table, lambda: containers).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert dict(rows(table.read(), "container_uuid", "logs")) == wanted
    assert all(len(text.encode()) < 65_535 for text in wanted.values())


def test_deletes_are_seen_once_until_the_object_is_back(spark, tmp_path):
    tombstones = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "uuid STRING").schema, ["uuid"])
    keys = spark.createDataFrame([("a",)], "uuid STRING")
    assert jobs.first_deletes(keys, 0, tombstones).count() == 1
    assert jobs.first_deletes(keys, 1, tombstones).count() == 0
    jobs.reappeared(keys, 2, tombstones)
    assert jobs.first_deletes(keys, 3, tombstones).count() == 1


def test_pod_deletes_outrank_older_service_changes_of_any_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), ["pod", "service"])
    services = spark.createDataFrame([("s1", "shop", {"app": "web"})], "service_uuid STRING, namespace STRING, selector MAP<STRING, STRING>")
    pods = spark.createDataFrame([("p1", "shop", {"app": "web"}), ("p2", "shop", {"app": "web"})], "pod_uuid STRING, namespace STRING, labels MAP<STRING, STRING>")
    _, on_services, on_deletes = jobs.service_pods(store, lambda: services, lambda: pods)
    logs = store.tables["container_log"]
    log = spark.createDataFrame([("k1", "p1", "text", None), ("k2", "p2", "text", None)], logs.schema)
    logs.upsert(log, 10, "logs", 0)
    on_services(spark.createDataFrame([("s1", 7)], "uuid STRING, _seq BIGINT"), 10)
    gone = spark.createDataFrame([("p1", 9)], "uuid STRING, _seq BIGINT")
    for _ in range(2):  # a batch written again changes nothing
        on_deletes(gone, 3)
    assert rows(store.read("service_pod"), "pod_uuid") == [("p2",)]
    logs.delete(logs.keys_of(gone.withColumnRenamed("uuid", "pod_uuid"), "pod_uuid", 3, "pod"), 3, "pod")
    assert rows(logs.read(), "container_uuid") == [("k2",)]


def test_deletes_count_once_until_the_object_is_back(spark, tmp_path):
    seen = []
    schema = spark.createDataFrame([], "uuid STRING").schema
    store = Store(spark, str(tmp_path / "tables"), ["namespace"])
    log = [change("ADDED", 1, "a", space("a", 1), "namespace"), change("DELETED", 2, "a", None, "namespace"), change("DELETED", 3, "a", None, "namespace"),
           change("ADDED", 4, "a", space("a", 2), "namespace"), change("DELETED", 5, "a", None, "namespace")]
    replay(spark, tmp_path, log, 5, store, tombstones=KeyedTable(spark, str(tmp_path / "gone"), schema, ["uuid"]), on_delete=[lambda gone, number: seen.append(gone.count())])
    assert seen == [0, 1, 0, 0, 1]


def test_children_are_written_without_an_exchange(spark, tmp_path, monkeypatch):
    plans, write = {}, KeyedTable._write

    def recorded(self, rows, batch, step, writer):
        plans[self.path.rsplit("/", 1)[1]] = rows._jdf.queryExecution().executedPlan().toString()
        write(self, rows, batch, step, writer)

    monkeypatch.setattr(KeyedTable, "_write", recorded)
    store = Store(spark, str(tmp_path / "tables"), ["service"])
    ports = ",".join('{"name":"%s","port":%d}' % (name, port) for port, name in enumerate("abaab", 1))
    raw = '{"metadata":{"uid":"u","name":"s","labels":{"x":"y"}},"spec":{"ports":[%s]}}' % ports
    objects = parse_objects(spark.createDataFrame([(raw,)], "raw STRING"), "service")
    store.upsert("service", objects, F.lit("c"), F.lit("2024-02-01").cast("timestamp"), 0)
    assert {"service", "service_port", "service_label"} <= set(plans)
    assert [name for name, plan in plans.items() if "Exchange" in plan] == []
    table = store.tables["service_port"]
    for stored in (table, table.compact(str(tmp_path / "compacted"))):
        assert sorted((r["name"], r["port"]) for r in stored.read().collect()) == [("a", 4), ("b", 5)]
    # A later batch wins whatever was listed how late before.
    again = parse_objects(spark.createDataFrame([(raw.replace('"port":4', '"port":9'),)], "raw STRING"), "service")
    store.upsert("service", again, F.lit("c"), F.lit("2024-02-01").cast("timestamp"), 1)
    assert sorted((r["name"], r["port"]) for r in table.read().collect()) == [("a", 9), ("b", 5)]


def test_a_listing_reads_nothing_but_keys_of_its_cluster(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), ["namespace"])
    now = F.lit("2024-02-01").cast("timestamp")
    for batch, cluster in enumerate("cd"):
        raw = [('{"metadata":{"uid":"%s%d","name":"n"}}' % (cluster, k),) for k in range(3)]
        store.upsert("namespace", parse_objects(spark.createDataFrame(raw, "raw STRING"), "namespace"), F.lit(cluster), now, batch)
    keys = store.tables["namespace"].keys_where(F.col("cluster_uuid") == "c")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(cluster_uuid,c),EqualTo(_deleted,true))" in plan
    assert "document" not in plan.split("ReadSchema")[1]
    listed = parse_objects(spark.createDataFrame([('{"metadata":{"uid":"c1","name":"n"}}',)], "raw STRING"), "namespace")
    assert store.reconcile("namespace", listed, F.lit("c"), 2).count() == 2
    assert sorted(r["uid"] for r in store.read("namespace").collect()) == ["c1", "d0", "d1", "d2"]
    assert store.tables["namespace"].keys_where(F.col("cluster_uuid") == "c").count() == 1

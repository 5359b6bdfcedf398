"""Operators against brute force and hand-computed values, with one hot key in the data."""

import json
import random

import pytest
from pyspark.sql import functions as F

from clusterlens import schemas
from clusterlens.functions.state import STATE_NAMES
from clusterlens.operators import health, logs, merge, metrics, notify, relate
from clusterlens.plans import catalog
from clusterlens.plans.registry import kinds
from clusterlens.sources import readers
from test_functions import model_tail


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


# --------------------------------------------------------------------------- selectors


@pytest.mark.parametrize("same_namespace", [True, False])
def test_selectors_match_brute_force(spark, same_namespace):
    rng = random.Random(7)
    pods = [(i, f"n{rng.randrange(2)}", {"app": "hot" if i % 3 == 0 else f"a{rng.randrange(6)}", "env": "prod", **({"x": "1"} if i % 5 == 0 else {})}) for i in range(300)]
    services = [(i, f"n{rng.randrange(2)}", dict(rng.sample([("app", "hot"), ("app", "a1"), ("env", "prod"), ("x", "1"), ("gone", "1")], k=rng.randrange(3)))) for i in range(60)]
    expected = sorted(
        (s, p) for s, sn, sel in services for p, pn, labels in pods if sel and (not same_namespace or sn == pn) and all(labels.get(k) == v for k, v in sel.items())
    )
    left = spark.createDataFrame(services, "service_uuid INT, namespace STRING, selector MAP<STRING, STRING>")
    right = spark.createDataFrame(pods, "pod_uuid INT, namespace STRING, labels MAP<STRING, STRING>")
    assert rows(relate.select_pods(left, right, same_namespace=same_namespace), "service_uuid", "pod_uuid") == expected


def test_selectors_within_a_cluster(spark):
    left = spark.createDataFrame([("s", "c1", "n", {"a": "1"})], "service_uuid STRING, cluster_uuid STRING, namespace STRING, selector MAP<STRING, STRING>")
    right = spark.createDataFrame([("p1", "c1", "n", {"a": "1"}), ("p2", "c2", "n", {"a": "1"})], "pod_uuid STRING, cluster_uuid STRING, namespace STRING, labels MAP<STRING, STRING>")
    assert rows(relate.select_pods(left, right, within=["cluster_uuid"]), "pod_uuid") == [("p1",)]


def test_orphans_fail_closed(spark):
    references = spark.createDataFrame([("pod", "a"), ("pod", "b"), ("node", "a")], "resource STRING, uuid STRING")
    pods = spark.createDataFrame([("a",)], "uuid STRING")
    with pytest.raises(Exception, match="no table to look references up in: node"):
        relate.orphans(references, {"pod": pods}).collect()
    assert rows(relate.orphans(references, {"pod": pods, "node": pods}), "resource", "uuid") == [("pod", "b")]


# --------------------------------------------------------------------------- logs


@pytest.mark.parametrize("size", [50, 1000, 65_535])
def test_log_tails_match_brute_force(spark, size):
    rng = random.Random(size)
    chunks = []
    for key, count in (("hot", 3000), ("small", 3), ("empty", 2)):
        # Sparse positions, so that several coarse ranges are in use.
        for seq in sorted(rng.sample(range(5_000_000), count)):
            body = "" if key == "empty" else "".join(rng.choice("aé日\n") for _ in range(rng.randrange(60)))
            chunks.append((key, seq, body))
    rng.shuffle(chunks)
    found = dict(rows(logs.log_tails(spark.createDataFrame(chunks, "key STRING, seq BIGINT, text STRING"), ["key"], size=size), "key", "logs"))
    for key in ("hot", "small"):
        assert found[key] == model_tail("".join(t for k, _, t in sorted(chunks) if k == key), size)
    assert "empty" not in found


def test_tail_at_a_chunk_border_is_still_cut_to_whole_lines(spark):
    chunks = spark.createDataFrame([("k", 1, "aaaa"), ("k", 2, "bb\ncc")], "key STRING, seq BIGINT, text STRING")
    assert rows(logs.log_tails(chunks, ["key"], size=5), "logs") == [("cc",)]


# --------------------------------------------------------------------------- maintenance


def test_merges_are_idempotent(spark):
    current = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k INT, seq INT, v STRING")
    changes = spark.createDataFrame([(2, 2, "B"), (3, 1, "c")], "k INT, seq INT, v STRING")
    once = merge.merge_latest(current, changes, ["k"], ["seq"])
    twice = merge.merge_latest(once, changes, ["k"], ["seq"])
    assert rows(once, "k", "v") == rows(twice, "k", "v") == [(1, "a"), (2, "B"), (3, "c")]


def test_replace_prefix_only_touches_locked_rows_of_the_cluster(spark):
    old = [("c1", "a.x", "1", True), ("c1", "a.y", "2", False), ("c1", "b.x", "3", True), ("c2", "a.x", "4", True)]
    current = spark.createDataFrame(old, schemas.SETTING)
    fresh = spark.createDataFrame([("c1", "a.z", "5", True)], schemas.SETTING)
    found = rows(merge.replace_prefix(current, fresh, F.lit("c1"), "a."), "cluster_uuid", "key")
    assert found == [("c1", "a.y"), ("c1", "a.z"), ("c1", "b.x"), ("c2", "a.x")]


# --------------------------------------------------------------------------- metrics


def samples(spark, data):
    frame = spark.createDataFrame(data, "metric STRING, labels MAP<STRING, STRING>, t BIGINT, value DOUBLE")
    return frame.select("metric", "labels", F.timestamp_millis("t").alias("ts"), "value")


def at(minutes):
    return int(minutes * 60_000)


def test_rate_of_a_steady_counter_and_of_one_with_a_reset(spark):
    steady = [("m", {"s": "steady"}, at(i / 2), 30.0 * i) for i in range(1, 9)]
    reset = [("m", {"s": "reset"}, at(i / 2), v) for i, v in enumerate([10.0, 20.0, 5.0, 15.0], start=1)]
    single = [("m", {"s": "single"}, at(1), 1.0)]
    found = {(s, tick): round(v, 9) for s, tick, v in rows(metrics.rate(samples(spark, steady + reset + single), "m", at(2), ["s"]), "s", "tick", "value")}
    # 1 per second; the window (2 min, 4 min] holds four samples and starts half a minute before the first.
    assert found[("steady", at(4))] == 1.0
    # Increases 10, 5 (after the reset from 20) and 10 over 1.5 minutes.  The window starts half a
    # minute before the first sample, but the counter was zero 10/25 of 1.5 minutes before it.
    assert found[("reset", at(2))] == round(25 * (120 / 90) / 120, 9)
    assert not [key for key in found if key[0] == "single"]


def test_instants_go_stale_after_five_minutes_and_end_at_nan(spark):
    data = [("m", {"s": "a"}, at(1) + 1, 1.0), ("m", {"s": "a"}, at(4), float("nan")), ("m", {"s": "b"}, at(61), 7.0)]
    found = rows(metrics.instant(samples(spark, data), "m", ["s"]).where("not isnan(value)"), "s", "tick", "value")
    assert found == [("a", at(i), 1.0) for i in range(2, 4)] + [("b", at(i), 7.0) for i in range(61, 66)]


def test_the_latest_tick_of_a_minute_counts(spark):
    data = [("kube_pod_container_resource_requests", {"resource": "cpu", "node": "a", "pod": "p"}, at(1), 2.0), ("machine_cpu_cores", {"node": "a"}, at(1), 4.0)]
    data += [("machine_cpu_cores", {"node": "a"}, at(1) + 30_000, 8.0)]
    entry = catalog.catalog()["N03"]
    vector = catalog.vector(entry, samples(spark, data), step=30_000, lookback=60_000)
    nodes = spark.createDataFrame([("a", "uuid-a")], "node STRING, node_uuid STRING")
    found = rows(catalog.metric_rows(entry, vector, nodes=nodes), "entity_uuid", "timestamp", "value")
    assert found[0] == ("uuid-a", at(1), 0.25)


def test_capacities_that_do_not_fit_are_null(spark):
    volumes = [{"metadata": {"uid": n, "name": n}, "spec": {"capacity": c}} for n, c in (("a", {"storage": "9Pi"}), ("b", {}), ("c", {"storage": "1Ki"}))]
    read = readers.parse_objects(spark.createDataFrame([(json.dumps(v),) for v in volumes], "raw STRING"), "persistent_volume")
    tables = kinds()["persistent_volume"].tables(read, F.lit("c"), F.lit(None).cast("timestamp"))
    found = {r["name"]: r["capacity"] for r in tables["persistent_volume"].collect()}
    assert found == {"a": None, "b": 0, "c": 1_024_000}


def test_division_by_zero_and_unknown_nodes_are_dropped(spark):
    data = [("kube_pod_container_resource_requests", {"resource": "cpu", "node": n, "pod": "p"}, at(1), 2.0) for n in ("a", "b", "zero")]
    data += [("machine_cpu_cores", {"node": n}, at(1), c) for n, c in (("a", 4.0), ("b", 8.0), ("zero", 0.0))]
    entry = catalog.catalog()["N03"]
    vector = catalog.vector(entry, samples(spark, data))
    assert {n for (n,) in rows(vector, "node")} == {"a", "b"}
    nodes = spark.createDataFrame([("a", "uuid-a")], "node STRING, node_uuid STRING")
    found = rows(catalog.metric_rows(entry, vector, nodes=nodes), "entity_uuid", "timestamp", "category", "name", "value")
    assert found == [("uuid-a", at(i), "cpu.request.percentage", "", 0.5) for i in range(1, 6)]


def test_scopes_keep_clusters_apart(spark):
    one = samples(spark, [("kube_node_info", {"node": n}, at(1), 1.0) for n in "ab"]).withColumn("cluster_uuid", F.lit("c1"))
    two = samples(spark, [("kube_node_info", {"node": "a"}, at(1), 1.0)]).withColumn("cluster_uuid", F.lit("c2"))
    entry = catalog.catalog()["C01"]
    scope = ["cluster_uuid"]
    found = catalog.metric_rows(entry, catalog.vector(entry, one.unionByName(two), scope=scope), scope=scope)
    assert set(rows(found, "entity_uuid", "value")) == {("c1", 2.0), ("c2", 1.0)}


def test_the_library_is_complete(spark):
    found = catalog.catalog()
    assert len(found) == 45
    assert {level: sum(m.level == level for m in found.values()) for level in ("cluster", "node", "pod", "container")} == {
        "cluster": 12,
        "node": 13,
        "pod": 12,
        "container": 8,
    }


# --------------------------------------------------------------------------- health options


def verdict(spark, column):
    row = spark.range(1).select(column.alias("v")).first()["v"]
    return STATE_NAMES[row["rank"]], row["reason"]


def conditions(*pairs):
    entries = [F.struct(F.lit(t).alias("type"), F.lit(s).alias("status"), F.lit("msg").alias("message")) for t, s in pairs]
    return F.array(*entries)


def test_deployment_conditions_count_on_request(spark):
    args = (F.lit("ns"), F.lit("d"), F.lit(1), F.lit(1), F.lit(0))
    assert verdict(spark, health.deployment_verdict(*args, conditions(("Available", "False"))))[0] == "ok"
    found = [
        verdict(spark, health.deployment_verdict(*args, conditions(*c), use_conditions=True))
        for c in ([("Available", "False")], [("ReplicaFailure", "True")], [("Available", "True"), ("ReplicaFailure", "False")])
    ]
    assert found == [
        ("critical", "Deployment ns/d is not available: msg."),
        ("critical", "Deployment ns/d has replica failure: msg."),
        ("ok", "Deployment ns/d has all 1 desired replicas available."),
    ]


def test_replica_set_conditions_count_on_request(spark):
    args = (F.lit("ns"), F.lit("r"), F.lit(1), F.lit(1), conditions(("ReplicaFailure", "True")))
    assert verdict(spark, health.replica_set_verdict(*args))[0] == "ok"
    assert verdict(spark, health.replica_set_verdict(*args, use_conditions=True)) == ("critical", "ReplicaSet ns/r has a failure condition: msg.")


def test_strict_counts_leave_init_containers_out(spark):
    fold = F.struct(F.lit(4).alias("rank"), F.lit("why").alias("reasons"), F.lit(2).alias("not_ok"), F.lit(1).alias("not_ok_main"), F.lit(3).alias("total"))
    pod = {"metadata": {"name": "p", "namespace": "n"}, "status": {"phase": "Running"}}
    objects = readers.parse_objects(spark.createDataFrame([(json.dumps(pod),)], "raw STRING"), "pod")
    now = F.lit("2024-01-01").cast("timestamp")
    texts = [
        objects.select(health.pod_verdict(F.col("metadata"), F.col("status"), fold, now, strict_counts=strict)["reason"]).first()[0] for strict in (False, True)
    ]
    assert [t.splitlines()[0] for t in texts] == [f"Pod n/p is critical with {n} out of 3 containers running." for n in (1, 2)]


# --------------------------------------------------------------------------- rules and sources


def test_rules_are_read_and_bad_ones_reported(spark):
    table = spark.createDataFrame([("1", ""), ("2", '{"version": 1, "kind": "pod", "query": "SELECT 1", "args": [1, ":uuid"]}'), ("3", "{"), ("4", '{"version": 2}')], schemas.RULE)
    usable, rejected = notify.load_rules(table)
    assert [(r.id, r.kind, r.args) for r in usable] == [("1", None, ()), ("2", "pod", (1, ":uuid"))]
    assert sorted(rejected) == ["3", "4"]
    assert [r["rule"] is None for r in readers.decoded_rules(table).orderBy("id").collect()][:2] == [True, False]


def test_any_number_of_rules_is_loaded(spark):
    table = spark.range(10_001).selectExpr("cast(id as string) as id", """concat('{"version": 1, "kind": "pod", "query": "SELECT ', id, '"}') as filter""")
    usable, rejected = notify.load_rules(table)
    assert len(usable) == 10_001 and not rejected
    events = spark.createDataFrame([("u", "c", "pod")], "uuid STRING, cluster_uuid STRING, kind STRING")
    routed, failed = notify.match_rules(spark, events, usable[:130], {})
    assert not failed and len(routed.first()["rule_ids"]) == 130


def test_placeholders_in_quoted_text_stay(spark):
    query = notify._bound("SELECT 1 FROM t WHERE a = ? AND b = '?' AND c = ? AND d = ?", (":uuid", "string", "void"))
    assert query == "SELECT 1 FROM t WHERE a = _event.uuid AND b = '?' AND c = _rule.p1 AND d = NULL"


def test_rules_are_judged_as_the_parser_does(spark):
    filters = [
        None, "", "{", "[1]", "1", "null", '{"version": 2, "kind": "pod", "query": "q"}', '{"kind": "pod", "query": "q"}', '{"version": 1, "query": "q"}',
        '{"version": 1, "kind": "pod"}', '{"version": 1, "kind": "", "query": "q"}', '{"version": 1, "kind": "pod", "query": "q"}',
        '{"version": 1, "kind": "pod", "query": "q", "args": 5}', '{"version": 1, "kind": "pod", "query": "q", "args": null}',
        '{"version": 1, "kind": "pod", "query": "q", "args": [":uuid", "x", 1, 1.5, true, null]}',
    ]
    table = spark.createDataFrame([(str(i), f) for i, f in enumerate(filters)], "id STRING, filter STRING")
    judged = {r.id: r for r in notify.judged_rules(table).collect()}
    usable, rejected = notify.load_rules(table)
    assert {i for i, r in judged.items() if r.reason} == set(rejected)
    for rule in usable:
        assert (judged[rule.id].kind, judged[rule.id].query) == (rule.kind, rule.query)
    assert judged["14"].types == [":uuid", "string", "bigint", "double", "boolean", "void"]
    assert judged["14"].args == [":uuid", "x", "1", "1.5", "true", None]


def test_a_chain_of_1000_takes_ten_rounds(spark, tmp_path):
    edges = spark.range(1000).selectExpr("id AS child", "id + 1 AS owner")
    found = relate.reachable(edges)
    assert found.count() == 1000 * 1001 // 2 and found.where("distance <> ancestor - child").count() == 0
    assert len({f.split("reach=")[1].split("/")[0] for f in found.inputFiles()}) <= 11
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 0), (5, 2), (7, None)], "child bigint, owner bigint")
    expected = [(0, 0, 3), (0, 1, 1), (0, 2, 2), (1, 0, 2), (1, 1, 3), (1, 2, 1), (2, 0, 1), (2, 1, 2), (2, 2, 3), (5, 0, 1), (5, 1, 2), (5, 2, 1)]
    assert sorted(map(tuple, relate.reachable(cycle).collect())) == expected


def test_snapshots_in_both_layouts(spark, tmp_path):
    objects = [{"metadata": {"uid": u, "name": u}, "immutable": u == "a"} for u in ("a", "b")]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(o) for o in objects) + "\n")
    (tmp_path / "list.json").write_text(json.dumps({"kind": "List", "items": objects}, indent=1))
    for path, listing in (("lines.json", False), ("list.json", True)):
        read = readers.read_objects(spark, str(tmp_path / path), "config_map", listing=listing)
        now = F.lit(None).cast("timestamp")
        tables = kinds()["config_map"].tables(read, F.lit("c"), now)
        assert rows(tables["config_map"], "name", "immutable") == [("a", True), ("b", False)]
        assert all(json.loads(r["raw"])["metadata"] for r in read.collect())


def test_incidents_and_settings(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"object_tags": {"uuid": "u", "resource": "pod", "name": "n", "namespace": "x"}}, {"object_tags": {"uuid": "v", "resource": "node"}}]))
    assert rows(readers.read_incidents(spark, str(tmp_path / "i.json")), "uuid", "resource") == [("u", "pod"), ("v", "node")]
    table = spark.createDataFrame([("c1", "prometheus.url", "u1", True), ("c2", "prometheus.url", "u2", True)], schemas.SETTING)
    wide = readers.settings(table, F.lit("c1"))
    assert rows(wide, "cluster_uuid", "prometheus_url", "notifications_url") == [("c1", "u1", None)]

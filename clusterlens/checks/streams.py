"""Streaming jobs run to the end of their input.

The tables they keep lie in the shared scratch folder of the session.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.checks.base import query
from clusterlens.checks.core import _labelled_parts, _services
from clusterlens.checks.series import _lookups, _nodes_view, _stored_sql, rounded
from clusterlens.checks.views import OP, metric_samples
from clusterlens.functions.ids import ensure_uuid
from clusterlens.operators import relate
from clusterlens.plans import catalog
from clusterlens.plans.sync import Store
from clusterlens.session import scratch_dir
from clusterlens.sources.readers import parse_objects, read_changes, read_samples
from clusterlens.sources.tables import KeyedTable
from clusterlens.streaming import jobs, polling, selectors, state


def event_stream(t) -> DataFrame:
    """The events as a file stream."""
    return t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parquet*")


def finish(writer, checkpoint: str) -> None:
    _to_the_end(writer, checkpoint).start().awaitTermination()


def finish_stateful(t, writer, checkpoint: str) -> None:
    state.started(_to_the_end(writer, checkpoint), t.spark).awaitTermination()


def _to_the_end(writer, checkpoint: str):
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)


@query(
    "stream_minutes",
    """SELECT event_type, epoch_us(date_trunc('minute', ts)) // 1000 AS minute_ms, arg_max(value, (ts, value)) AS value
    FROM events GROUP BY 1, 2""",
)
def stream_minutes(t):
    folder = scratch_dir(t.spark, "minutes")
    schema = t.spark.createDataFrame([], "event_type STRING, minute TIMESTAMP, ts TIMESTAMP, value DOUBLE").schema
    table = KeyedTable(t.spark, f"{folder}/table", schema, ["event_type", "minute"])
    finish(jobs.metric_minutes(event_stream(t), table, ["event_type"]), f"{folder}/checkpoint")
    return table.read().select("event_type", F.unix_millis("minute").alias("minute_ms"), "value")


def _namespace(uid, version) -> Column:
    meta = F.struct(uid.alias("uid"), uid.alias("name"), version.cast("string").alias("resourceVersion"))
    return F.to_json(F.struct(meta.alias("metadata")))


def _replay(t, rows: DataFrame, name: str, batches: int) -> Store:
    """Rows (uid, seq, op) as changes of name spaces; each batch holds the changes of one remainder of ``seq``."""
    folder = scratch_dir(t.spark, name)
    store = Store(t.spark, f"{folder}/tables", ["namespace"])
    changes = rows.select(
        "op",
        "seq",
        F.lit("namespace").alias("kind"),
        "uid",
        F.col("uid").alias("key"),
        F.when(F.col("op") != "DELETED", _namespace(F.col("uid"), F.col("seq"))).alias("object"),
        F.lit("c1").alias("cluster_uuid"),
    )
    writer = jobs.object_changes(read_changes(t.spark, f"{folder}/in/*"), store, "namespace", clock=lambda: F.lit("2024-02-01").cast("timestamp"))
    for number in range(batches):
        changes.where(F.col("seq") % batches == number).write.json(f"{folder}/in/{number}")
        finish(writer, f"{folder}/checkpoint")
    return store


@query(
    "stream_changes",
    f"""SELECT 'u' || user_id AS name, event_id::VARCHAR AS resource_version FROM (SELECT *, {OP} AS op FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE op <> 'DELETED'""",
)
def stream_changes(t):
    """A change log applied by the streaming job in batches that do not follow its order."""
    uid = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid")
    store = _replay(t, t.events.select(uid, F.col("event_id").alias("seq"), F.expr(OP).alias("op")), "changes", 3)
    return store.read("namespace").select("name", "resource_version")


@query(
    "stream_reconcile",
    """SELECT 'c' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0
    EXCEPT SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 = 0""",
)
def stream_reconcile(t):
    """A listing deletes what is gone; a stream batch of the same number neither undoes that nor is undone."""
    folder = scratch_dir(t.spark, "reconcile")
    store = Store(t.spark, f"{folder}/tables", ["namespace"])
    uid, now, cluster = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("2024-02-01").cast("timestamp"), F.lit("c1")

    def objects(rows: DataFrame, seq: int) -> DataFrame:
        return parse_objects(rows.select(_namespace(uid, F.col("c_custkey")).alias("raw"), F.lit(seq).cast("bigint").alias("_seq")), "namespace")

    store.upsert("namespace", objects(t.customer, 1), cluster, now, 0)
    # Changed after the listing was made: these stay although they are not listed.
    store.upsert("namespace", objects(t.customer.where("c_custkey % 5 = 0"), 30), cluster, now, 1)
    store.reconcile("namespace", objects(t.customer.where("c_custkey % 2 = 0"), 20), cluster, 2, seq=20)
    gone = objects(t.customer.where("c_custkey % 7 = 0"), 40).select(ensure_uuid(F.col("metadata.uid")).alias("uuid"), "_seq")
    store.delete("namespace", gone, 2)
    return store.read("namespace").select("name")


@query(
    "child_last_wins",
    """SELECT 'p' || p_partkey AS protocol, CAST(p_size + 1 AS INTEGER) AS port FROM part""",
)
def child_last_wins(t):
    """Of children that an object lists twice under one key, the last one is stored."""
    folder = scratch_dir(t.spark, "children")
    store = Store(t.spark, f"{folder}/tables", ["service"])
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    ports = [F.struct(F.lit("http").alias("name"), name.alias("protocol"), (F.col("p_size") + k).alias("port")) for k in range(2)]
    raw = F.to_json(F.struct(F.struct(name.alias("uid"), name.alias("name")).alias("metadata"), F.struct(F.array(*ports).alias("ports")).alias("spec")))
    store.upsert("service", parse_objects(t.part.select(raw.alias("raw")), "service"), F.lit("c1"), F.lit("2024-02-01").cast("timestamp"), 0)
    return store.read("service_port").select("protocol", F.col("port").cast("int").alias("port"))


@query(
    "reconcile_children",
    """SELECT 'service' AS kind, 'c' || (p_partkey % 2) AS cluster, 's' || p_partkey AS name, 2::BIGINT AS ports,
      (p_size + 1090)::BIGINT AS port_sum, 1::BIGINT AS labels FROM part WHERE p_partkey % 4 <> 2
    UNION ALL SELECT 'pvc', 'c' || (p_partkey % 2), 'v' || p_partkey, NULL, NULL, 1 FROM part""",
)
def reconcile_children(t):
    """A listing of one of two clusters: what it lacks goes with its children; the other cluster and a kind in the same tables stay."""
    folder = scratch_dir(t.spark, "reconcile-children")
    store = Store(t.spark, f"{folder}/tables", ["service", "pvc"])
    # The port "a" is listed twice.
    numbers = (("a", F.lit(80)), ("b", F.lit(90)), ("a", F.col("p_size") + 1000))
    ports = F.array(*[F.struct(F.lit(name).alias("name"), port.cast("int").alias("port")) for name, port in numbers])

    def objects(rows: DataFrame, kind: str, prefix: str) -> DataFrame:
        uid = F.concat(F.lit(prefix), F.col("p_partkey").cast("string"))
        meta = F.struct(uid.alias("uid"), uid.alias("name"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("labels"))
        fields = [meta.alias("metadata"), *([F.struct(ports.alias("ports")).alias("spec")] if kind == "service" else [])]
        return parse_objects(rows.select(F.to_json(F.struct(*fields)).alias("raw")), kind)

    for number in range(2):
        rows = t.part.where(F.col("p_partkey") % 2 == number)
        for kind, prefix in (("service", "s"), ("pvc", "v")):
            store.upsert(kind, objects(rows, kind, prefix), F.lit(f"c{number}"), F.lit("2024-02-01").cast("timestamp"), number)
    store.reconcile("service", objects(t.part.where("p_partkey % 4 = 0"), "service", "s"), F.lit("c0"), 2)
    kept = [store.read(kind).select(F.lit(kind).alias("kind"), "uuid", F.col("cluster_uuid").alias("cluster"), "name") for kind in ("service", "pvc")]
    ports = store.read("service_port").groupBy(F.col("service_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("ports"), F.sum("port").alias("port_sum"))
    labels = store.read("resource_label").groupBy(F.col("resource_uuid").alias("uuid")).agg(F.count(F.lit(1)).alias("labels"))
    # Full joins: children without their object would show.
    return reduce(DataFrame.unionByName, kept).join(ports, "uuid", "full").join(labels, "uuid", "full").drop("uuid")


# --------------------------------------------------------------------------- state store and watermarks

_CHANGE_COLUMNS = ["op", "seq", "kind", "uid", "key", "object", "cluster_uuid"]


def _customer_changes(t) -> DataFrame:
    uid = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return t.customer.select(
        F.lit("ADDED").alias("op"),
        F.col("c_custkey").alias("seq"),
        F.lit("namespace").alias("kind"),
        uid.alias("uid"),
        uid.alias("key"),
        _namespace(uid, F.col("c_nationkey")).alias("object"),
        F.lit("c1").alias("cluster_uuid"),
    )


@query("stream_redelivered", "SELECT 'c' || c_custkey AS name, c_nationkey::VARCHAR AS resource_version, 1::BIGINT AS times FROM customer")
def stream_redelivered(t):
    """Every record is delivered three times over three batches; the consumer of upserts sees it once."""
    folder = scratch_dir(t.spark, "redelivered")
    store = Store(t.spark, f"{folder}/tables", ["namespace"])
    records = _customer_changes(t)

    def seen(rows: DataFrame, number: int) -> None:
        rows.select("name", "resource_version").write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    changes = read_changes(t.spark, f"{folder}/in/*").withColumn("received", F.col("_metadata.file_modification_time"))
    writer = jobs.object_changes(
        state.first_deliveries(changes),
        store,
        "namespace",
        clock=lambda: F.lit("2024-02-01").cast("timestamp"),
        stateful=True,
        on_upsert=[seen],
    )
    for number in range(3):
        # Twice within the batch in part, and again in the others.
        again = records.where(F.col("c_custkey") % 3 == number)
        records.where(F.col("c_custkey") % 3 != (number + 1) % 3).unionByName(again).write.json(f"{folder}/in/{number}")
        finish_stateful(t, writer, f"{folder}/checkpoint")
    found = t.spark.read.schema("name STRING, resource_version STRING").parquet(f"{folder}/seen")
    return found.groupBy("name", "resource_version").agg(F.count(F.lit(1)).alias("times"))


@query(
    "stream_delete_once",
    f"""WITH c AS (SELECT user_id, event_id, {OP} = 'DELETED' AS gone FROM events),
    s AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY user_id ORDER BY event_id), false) AS before FROM c)
    SELECT 'u' || user_id AS uid, event_id AS seq FROM s WHERE gone AND NOT before""",
)
def stream_delete_once(t):
    """Of the deletes of an object in a row the first one counts, also where the stream was started anew in between."""
    folder = scratch_dir(t.spark, "delete-once")
    rows = t.events.select(
        F.expr(OP).alias("op"),
        F.col("event_id").alias("seq"),
        F.lit("pod").alias("kind"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("uid"),
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("string").alias("object"),
        F.lit("c1").alias("cluster_uuid"),
    )
    middle = t.events.agg(F.max("event_id")).first()[0] // 2
    with state.keyed_state(t.spark):
        for number, part in enumerate((F.col("seq") <= middle, F.col("seq") > middle)):
            rows.where(part).write.json(f"{folder}/in/{number}")
            counted = state.delete_once(read_changes(t.spark, f"{folder}/in/*"), hours=10_000)
            finish_stateful(t, counted.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/checkpoint")
    return t.spark.read.schema("cluster_uuid STRING, kind STRING, uid STRING, seq BIGINT").parquet(f"{folder}/out").select("uid", "seq")


# The events up to MIDDLE come first; some of the last six hours and of days before are held back and come with the rest.
_MIDDLE, _LATE = "2024-01-16 00:00:00", "12 hours"
_NEAR = f"ts < TIMESTAMP '{_MIDDLE}' AND ts >= TIMESTAMP '2024-01-15 18:00:00' AND event_id % 2 = 0"
_FAR = f"ts < TIMESTAMP '2024-01-14 00:00:00' AND event_id % 10 = 0"


@query(
    "stream_minute_windows",
    f"""WITH e AS (SELECT *, ts < TIMESTAMP '{_MIDDLE}' AND NOT ({_NEAR}) AND NOT ({_FAR}) AS early FROM events),
    w AS (SELECT max(ts) - INTERVAL '{_LATE}' AS mark FROM e WHERE early)
    SELECT event_type, epoch_us(date_trunc('minute', ts)) // 1000 AS minute_ms, arg_max(value, (ts, value)) AS value FROM e, w
    WHERE event_id % 7 <> 0 AND (early OR date_trunc('minute', ts) + INTERVAL '1 minute' > date_trunc('millisecond', mark)) GROUP BY 1, 2""",
)
def stream_minute_windows(t):
    """Late rows within the allowed time count, later ones are dropped, and a minute is written once, when it is over."""
    folder = scratch_dir(t.spark, "minute-windows")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value")
    # Undefined samples move the watermark no further than defined ones: their time stays, their value does not count.
    rows = t.events.select("event_type", "ts", value, F.expr(f"ts < TIMESTAMP '{_MIDDLE}' AND NOT ({_NEAR}) AND NOT ({_FAR})").alias("early"))
    flush = t.spark.createDataFrame([("flush", datetime(2030, 1, 1), 0.0)], "event_type STRING, ts TIMESTAMP, value DOUBLE")
    schema = "event_type STRING, ts TIMESTAMP, value DOUBLE"
    parts = [rows.where("early").drop("early"), rows.where("NOT early").drop("early"), flush]
    for number, part in enumerate(parts):
        part.write.parquet(f"{folder}/in/{number}")
        windows = jobs.minute_windows(t.spark.readStream.schema(schema).parquet(f"{folder}/in/*"), ["event_type"], _LATE)
        finish_stateful(t, windows.writeStream.format("parquet").option("path", f"{folder}/out"), f"{folder}/checkpoint")
    found = t.spark.read.schema("event_type STRING, minute TIMESTAMP, value DOUBLE").parquet(f"{folder}/out")
    return found.select("event_type", F.unix_millis("minute").alias("minute_ms"), "value")


# --------------------------------------------------------------------------- consumers and children of the change job


def _change_records(rows: DataFrame, kind: str, uid, seq, document, op, cluster=None, keep=()) -> DataFrame:
    columns = {"op": op, "seq": seq, "kind": F.lit(kind), "uid": uid, "key": uid, "object": document, "cluster_uuid": cluster if cluster is not None else F.lit("c1")}
    return rows.select(*[c.alias(n) for n, c in columns.items()], *keep)


@query(
    "stream_notifications",
    """WITH w AS (SELECT o_custkey AS k, count(*) AS want, count(*) FILTER (o_orderstatus <> 'F') AS have, count(*) FILTER (o_orderstatus = 'P') AS missing
      FROM orders GROUP BY 1),
    v AS (SELECT k, 0 AS batch, want, have, missing FROM w UNION ALL SELECT k, 1, want, want, 0 FROM w WHERE k % 2 = 0),
    e AS (SELECT k, batch, concat('shop/d', k) AS name,
      CASE WHEN missing > 0 THEN 'crit' WHEN have < want THEN 'warning' ELSE 'ok' END AS severity,
      CASE WHEN missing > 0 THEN printf('Deployment shop/d%d has %d unavailable replicas.', k, missing)
        WHEN have < want THEN printf('Deployment shop/d%d only has %d out of %d desired replicas available.', k, have, want)
        ELSE printf('Deployment shop/d%d has all %d desired replicas available.', k, want) END AS message FROM v)
    SELECT batch, name, severity, message FROM e WHERE batch = 0 OR message <> (SELECT any_value(f.message) FROM e f WHERE f.k = e.k AND f.batch = 0)""",
)
def stream_notifications(t):
    """The change job with a notifier: the second batch changes some deployments and repeats others, which send nothing."""
    folder = scratch_dir(t.spark, "notifications")
    store = Store(t.spark, f"{folder}/tables", ["deployment"])
    sent = KeyedTable(t.spark, f"{folder}/sent", t.spark.createDataFrame([], "uuid STRING, severity STRING, message STRING").schema, ["uuid"])
    counts = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("want"), F.count_if(F.col("o_orderstatus") != "F").alias("have"), F.count_if(F.col("o_orderstatus") == "P").alias("missing")
    )
    uid = F.concat(F.lit("d"), F.col("k").cast("string"))
    meta = F.struct(uid.alias("uid"), uid.alias("name"), F.lit("shop").alias("namespace"))

    def document(have, missing):
        status = F.struct(have.alias("availableReplicas"), missing.alias("unavailableReplicas"))
        return F.to_json(F.struct(meta.alias("metadata"), F.struct(F.col("want").alias("replicas")).alias("spec"), status.alias("status")))

    first = _change_records(counts, "deployment", uid, F.col("k"), document(F.col("have"), F.col("missing")), F.lit("ADDED"))
    well = _change_records(counts.where("k % 2 = 0"), "deployment", uid, F.col("k") + 10**9, document(F.col("want"), F.lit(0)), F.lit("UPDATED"))
    again = _change_records(counts.where("k % 2 = 1 AND k % 3 = 0"), "deployment", uid, F.col("k") + 10**9, document(F.col("have"), F.col("missing")), F.lit("UPDATED"))
    notifier = jobs.health_notifications("deployment", jobs.json_sink(f"{folder}/events"), sent=sent)
    clock = lambda: F.lit("2024-02-01").cast("timestamp")
    writer = jobs.object_changes(read_changes(t.spark, f"{folder}/in/*"), store, "deployment", clock=clock, on_upsert=[notifier])
    for number, records in enumerate((first, well.unionByName(again))):
        records.write.json(f"{folder}/in/{number}")
        finish(writer, f"{folder}/checkpoint")
    found = t.spark.read.schema("name STRING, severity STRING, message STRING, writer STRING, batch INT").json(f"{folder}/events")
    return found.select("batch", "name", "severity", "message")


@query(
    "stream_cascade",
    """SELECT 'c' || (p_partkey % 2) AS cluster, concat('s', p_partkey) AS name, port FROM part, (VALUES ('a'), ('b')) AS v(port)
    WHERE p_partkey % 3 <> 0 OR p_partkey % 4 = 0""",
)
def stream_cascade(t):
    """Children go with their objects, of two clusters, though the deletes come a batch before the additions; what is added again later stays."""
    folder = scratch_dir(t.spark, "cascade")
    store = Store(t.spark, f"{folder}/tables", ["service"])
    key = F.col("p_partkey")
    uid, cluster = F.concat(F.lit("s"), key.cast("string")), F.concat(F.lit("c"), (key % 2).cast("string"))
    ports = [F.struct(F.lit(p).alias("name"), F.lit("TCP").alias("protocol"), F.lit(80 + k).alias("port")) for k, p in enumerate("ab")]
    meta = F.struct(uid.alias("uid"), uid.alias("name"))
    document = F.to_json(F.struct(meta.alias("metadata"), F.struct(F.array(*ports).alias("ports")).alias("spec")))

    def records(rows: DataFrame, seq: int, op: str, part) -> DataFrame:
        content = document if op != "DELETED" else F.lit(None).cast("string")
        found = _change_records(rows, "service", uid, F.lit(seq).cast("bigint"), content, F.lit(op), cluster)
        return found.withColumn("part", F.pmod(F.expr("cast(substr(uid, 2) AS bigint)") + part, F.lit(3)))

    log = [
        records(t.part, 10, "ADDED", 1),
        records(t.part.where("p_partkey % 3 = 0"), 20, "DELETED", 0),
        records(t.part.where("p_partkey % 12 = 0"), 30, "UPDATED", 2),
    ]
    rows = reduce(DataFrame.unionByName, log)
    writer = jobs.object_changes(read_changes(t.spark, f"{folder}/in/*"), store, "service", clock=lambda: F.lit("2024-02-01").cast("timestamp"))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.json(f"{folder}/in/{part}")
        finish(writer, f"{folder}/checkpoint")
    services = store.read("service").select(F.col("uuid").alias("service_uuid"), F.col("cluster_uuid").alias("cluster"), "name")
    # A full join: neither a port without its service nor a service without ports may be left.
    return store.read("service_port").select("service_uuid", F.col("name").alias("port")).join(services, "service_uuid", "full").select("cluster", "name", "port")


# --------------------------------------------------------------------------- services and their pods


@query(
    "stream_service_pods",
    """SELECT p_brand || '|' || p_type || '|' || (p_size % 2) AS service_uuid, p_partkey AS pod_uuid FROM part WHERE p_partkey % 7 <> 1 AND p_partkey % 11 <> 0
    UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 7 <> 1 AND p_partkey % 11 <> 0""",
)
def stream_service_pods(t):
    """Three batches in which pods and services arrive, change and go in any order: older versions after newer ones, deletes before additions."""
    folder = scratch_dir(t.spark, "service-pods")
    pods, services = _labelled_parts(t), _services(t)
    pod_uid, service_uid = F.concat(F.lit("p"), F.col("pod_uuid").cast("string")), F.col("service_uuid")

    def changes(rows: DataFrame, kind: str, uid, seq: int, part, labels=None, selector=None, op: str = "UPDATED") -> DataFrame:
        meta = F.struct(uid.alias("uid"), uid.alias("name"), F.col("namespace"), *([labels.alias("labels")] if labels is not None else []))
        fields = [meta.alias("metadata"), *([F.struct(selector.alias("selector")).alias("spec")] if selector is not None else [])]
        document = F.to_json(F.struct(*fields)) if op != "DELETED" else F.lit(None).cast("string")
        part = F.pmod(part, F.lit(3)).alias("part")
        return _change_records(rows.select("*", part), kind, uid, F.lit(seq), document, F.lit(op), keep=("part",))

    number = F.col("pod_uuid")
    all_ = F.create_map(F.lit("tier"), F.lit("shop"))  # would select every pod
    moved = F.create_map(F.lit("tier"), F.lit("other"))
    some = F.xxhash64("service_uuid")
    log = [
        changes(pods, "pod", pod_uid, 100, number, labels=F.col("labels")),
        changes(pods.where("pod_uuid % 5 = 0"), "pod", pod_uid, 50, number + 1, labels=moved),  # older, though it comes later
        changes(pods.where("pod_uuid % 7 = 1"), "pod", pod_uid, 200, number + 2, labels=moved),
        changes(pods.where("pod_uuid % 11 = 0"), "pod", pod_uid, 300, number + 1, op="DELETED"),
        changes(services, "service", service_uid, 20, some, selector=F.col("selector")),
        changes(services, "service", service_uid, 10, some + 1, selector=all_),
        changes(services.where("service_uuid NOT LIKE '%|%' AND size(selector) = 0"), "service", service_uid, 400, some + 2, op="DELETED"),
    ]
    rows = reduce(DataFrame.unionByName, log)
    index = selectors.SelectorIndex(t.spark, f"{folder}/index")
    writer = selectors.service_pods(read_changes(t.spark, f"{folder}/in/*"), index)
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.json(f"{folder}/in/{part}")
        finish(writer, f"{folder}/checkpoint")
    names = services.select(ensure_uuid(service_uid).alias("a"), "service_uuid")
    numbers = pods.select(ensure_uuid(pod_uid).alias("b"), "pod_uuid")
    found = index.read().select(F.col("service_uuid").alias("a"), F.col("pod_uuid").alias("b"))
    return found.join(names, "a").join(numbers, "b").select("service_uuid", "pod_uuid")


# --------------------------------------------------------------------------- metrics as their samples arrive


def _polled(t, level: str, lookups) -> DataFrame:
    """The samples of a level in three batches that interleave, the last of them partly delivered before."""
    folder = scratch_dir(t.spark, f"polled-{level}")
    sources = {source for e in catalog.catalog().values() if e.level == level for source in e.sources}
    samples = metric_samples(t, tuple(sources)).withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(3)))
    states = polling.StepStates(t.spark, f"{folder}/states")
    writer = polling.metric_level(read_samples(t.spark, f"{folder}/in/*", stream=True), level, states, f"{folder}/rows", lookups=lookups)
    for number in (2, 0, 1):
        chosen = F.col("part") == number
        again = chosen | (F.col("part") == 2) & (F.unix_millis("ts") % 10 == 0) if number == 1 else chosen
        samples.where(again).drop("part").write.parquet(f"{folder}/in/{number}")
        finish(writer, f"{folder}/checkpoint")
    return rounded(polling.read_rows(t.spark, f"{folder}/rows").drop("hour"))


def _level_sql(level: str) -> str:
    letter = {catalog.CLUSTER: "C", catalog.NODE: "N"}[level]
    return " UNION ALL ".join(_stored_sql(i) for i in sorted(catalog_ids()) if i[0] == letter)


def catalog_ids() -> list[str]:
    from clusterlens.checks.series import _ALL_STORED

    return list(_ALL_STORED)


@query("stream_metric_level_node", _level_sql(catalog.NODE))
def stream_metric_level_node(t):
    """All node metrics from out-of-order batches; a node is renamed meanwhile and seen when its dimension is refreshed."""
    clock = [datetime(2024, 1, 1)]

    def load() -> DataFrame:
        known = _nodes_view(t)
        early = clock[0] < datetime(2024, 1, 1, 1)
        return relate.node_names(known.withColumn("name", F.concat(F.lit("old-"), "name")) if early else known)

    nodes = polling.Refreshed(t.spark, load, clock=lambda: clock[0])

    def lookups() -> dict:
        found = {"nodes": nodes()}
        clock[0] += timedelta(minutes=40)  # the second batch still has the first copy, the third one reads anew
        return found

    return _polled(t, catalog.NODE, lookups)


@query("stream_metric_level_cluster", _level_sql(catalog.CLUSTER))
def stream_metric_level_cluster(t):
    return _polled(t, catalog.CLUSTER, lambda: _lookups(t, catalog.CLUSTER))

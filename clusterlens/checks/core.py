"""Roll-ups, health, relations and table maintenance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.checks.base import OBJECT_SPACE, query, sql_uuid5
from clusterlens.checks.views import OP, RESOURCE_VALUES, SQL_CONTAINERS, changes, containers
from clusterlens.functions import ids, quantity, text
from clusterlens.functions.state import severity, state_name
from clusterlens.operators import health, logs, merge, notify, relate, rollup
from clusterlens.sources import readers

STATE_SQL = "['ok','pending','unknown','warning','critical']"
SEVERITY_SQL = "['ok','info','err','warning','crit']"


# --------------------------------------------------------------------------- roll-ups

_NEEDS = ", ".join(
    f"CAST(greatest(sum({r}) FILTER (role = 'app'), max({r}) FILTER (role <> 'app')) AS BIGINT) AS {r}"
    for r in RESOURCE_VALUES
)


@query(
    "pod_rollup",
    f"""WITH c AS ({SQL_CONTAINERS})
    SELECT l_orderkey, CAST(max(rank) AS INTEGER) AS rank, count(*) AS children,
      CAST(count(*) FILTER (rank > 0) AS BIGINT) AS not_ok, {_NEEDS},
      {STATE_SQL}[CAST(max(rank) AS INTEGER) + 1] AS state
    FROM c GROUP BY l_orderkey""",
)
def pod_rollup(t):
    return rollup.pod_summary(containers(t), ["l_orderkey"]).withColumn("state", state_name(F.col("rank")))


@query(
    "worst_state",
    f"""WITH c AS ({SQL_CONTAINERS})
    SELECT l_orderkey, role, CAST(max(rank) AS INTEGER) AS rank, count(*) AS children,
      CAST(count(*) FILTER (rank > 0) AS BIGINT) AS not_ok FROM c GROUP BY ALL""",
)
def worst_state(t):
    return rollup.worst_state(containers(t), ["l_orderkey", "role"])


@query("pod_resources", f"WITH c AS ({SQL_CONTAINERS}) SELECT l_orderkey, {_NEEDS} FROM c GROUP BY l_orderkey")
def pod_resources(t):
    return rollup.pod_resources(containers(t), ["l_orderkey"])


@query(
    "condition_fold",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'signup')) AS value
    FROM events GROUP BY user_id""",
)
def condition_fold(t):
    return rollup.last_match(
        t.events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "signup"), F.col("event_type")
    )


@query(
    "job_first_condition",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')) AS value
    FROM events GROUP BY user_id""",
)
def job_first_condition(t):
    return rollup.first_match(
        t.events, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("purchase", "error"), F.col("event_type")
    )


@query("latest_version", "SELECT arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders")
def latest_version(t):
    return rollup.latest_row(t.orders, "o_orderkey", "o_orderpriority")


_MODE_SQL = (
    "CASE l_returnflag WHEN 'A' THEN (CASE l_linestatus WHEN 'F' THEN 'ReadWriteOnce' ELSE 'ReadOnlyMany' END)"
    " WHEN 'N' THEN (CASE l_linestatus WHEN 'F' THEN 'ReadWriteMany' ELSE 'ReadWriteOncePod' END) ELSE 'Other' END"
)


@query(
    "access_bitmask",
    f"""SELECT l_orderkey, CAST(m AS SMALLINT) AS access_modes,
      CAST(nullif(coalesce(m, 0) | 4, 0) AS SMALLINT) AS with_many, CAST(nullif(coalesce(m, 0) & ~1, 0) AS SMALLINT) AS without_once,
      CAST(nullif(xor(coalesce(m, 0), 2), 0) AS SMALLINT) AS toggled, (coalesce(m, 0) & 8) <> 0 AS has_pod
    FROM (SELECT l_orderkey, nullif(bit_or(CASE mode WHEN 'ReadWriteOnce' THEN 1 WHEN 'ReadOnlyMany' THEN 2
        WHEN 'ReadWriteMany' THEN 4 WHEN 'ReadWriteOncePod' THEN 8 ELSE 0 END), 0) AS m
      FROM (SELECT l_orderkey, {_MODE_SQL} AS mode FROM lineitem) GROUP BY l_orderkey)""",
)
def access_bitmask(t):
    rows = t.lineitem.select("l_orderkey", F.expr(_MODE_SQL).alias("mode"))
    mask = F.col("access_modes")
    return rollup.access_modes(rows, ["l_orderkey"], "mode").select(
        "l_orderkey",
        "access_modes",
        quantity.bit_set(mask, 4).alias("with_many"),
        quantity.bit_clear(mask, 1).alias("without_once"),
        quantity.bit_toggle(mask, 2).alias("toggled"),
        quantity.bit_has(mask, 8).alias("has_pod"),
    )


# --------------------------------------------------------------------------- health over counts

_COUNTS_SQL = """SELECT c_custkey, c_name, coalesce(desired, 0) AS want, coalesce(available, 0) AS have, coalesce(unavailable, 0) AS missing
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS desired, count(*) FILTER (o_orderstatus <> 'F') AS available,
      count(*) FILTER (o_orderstatus = 'P') AS unavailable FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


@query(
    "workload_health",
    f"""WITH w AS ({_COUNTS_SQL}), x AS (SELECT *, 'shop/' || c_name AS n FROM w)
    SELECT c_custkey,
      CASE WHEN missing > 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS deployment_state,
      CASE WHEN missing > 0 THEN printf('Deployment %s has %d unavailable replicas.', n, missing)
        WHEN have < want THEN printf('Deployment %s only has %d out of %d desired replicas available.', n, have, want)
        ELSE printf('Deployment %s has all %d desired replicas available.', n, want) END AS deployment_reason,
      CASE WHEN want < 1 THEN 'unknown' WHEN have = 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS daemon_set_state,
      CASE WHEN want < 1 THEN printf('DaemonSet %s has an invalid desired node count: %d.', n, want)
        WHEN have = 0 THEN printf('DaemonSet %s does not have a single pod available which should run on %d desired nodes.', n, want)
        WHEN have < want THEN printf('DaemonSet %s pods are only available on %d out of %d desired nodes.', n, have, want)
        ELSE printf('DaemonSet %s has pods available on all %d desired nodes.', n, want) END AS daemon_set_reason,
      CASE WHEN have < 1 AND want > 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS replica_set_state,
      CASE WHEN have < 1 AND want > 0 THEN printf('ReplicaSet %s has no replica available from %d desired.', n, want)
        WHEN have < want THEN printf('ReplicaSet %s only has %d out of %d desired replicas available.', n, have, want)
        ELSE printf('ReplicaSet %s has all %d desired replicas available.', n, want) END AS replica_set_reason,
      CASE WHEN have = 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS stateful_set_state,
      CASE WHEN have = 0 THEN printf('StatefulSet %s has no replica available from %d desired.', n, want)
        WHEN have < want THEN printf('StatefulSet %s only has %d out of %d desired replicas available.', n, have, want)
        ELSE printf('StatefulSet %s has all %d desired replicas available.', n, want) END AS stateful_set_reason
    FROM x""",
)
def workload_health(t):
    counts = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("want"),
        F.count_if(F.col("o_orderstatus") != "F").alias("have"),
        F.count_if(F.col("o_orderstatus") == "P").alias("missing"),
    )
    rows = t.customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left")
    ns, name, want, have = F.lit("shop"), F.col("c_name"), F.col("want"), F.col("have")
    verdicts = {
        "deployment": health.deployment_verdict(ns, name, want, have, F.col("missing")),
        "daemon_set": health.daemon_set_verdict(ns, name, want, have),
        "replica_set": health.replica_set_verdict(ns, name, want, have),
        "stateful_set": health.stateful_set_verdict(ns, name, want, have),
    }
    return rows.select(
        "c_custkey",
        *[state_name(v["rank"]).alias(f"{kind}_state") for kind, v in verdicts.items()],
        *[v["reason"].alias(f"{kind}_reason") for kind, v in verdicts.items()],
    )


_RFC = "'%Y-%m-%dT%H:%M:%SZ'"


@query(
    "cron_health",
    f"""WITH u AS (SELECT user_id, concat('user-', user_id) AS n, date_trunc('second', max(ts) FILTER (event_type = 'signup')) AS s,
        date_trunc('second', max(ts) FILTER (event_type = 'purchase')) AS p,
        CASE WHEN user_id % 3 = 0 THEN 1209600 END AS d FROM events GROUP BY user_id),
      x AS (SELECT *, s + to_seconds(d) AS due FROM u)
    SELECT user_id,
      CASE WHEN s IS NULL THEN 'warning' WHEN p IS NULL THEN 'critical' WHEN TIMESTAMP '2024-02-05' > due THEN 'critical'
        WHEN s > p THEN 'warning' WHEN user_id % 5 = 0 THEN 'warning' ELSE 'ok' END AS state,
      CASE WHEN s IS NULL THEN concat('CronJob ', n, ' has never been scheduled.')
        WHEN p IS NULL THEN concat('CronJob ', n, ' has never completed successfully.')
        WHEN TIMESTAMP '2024-02-05' > due THEN concat('CronJob ', n, ' missed its starting deadline. Last scheduled at ',
          strftime(s, {_RFC}), ', deadline was ', strftime(due, {_RFC}), '.')
        WHEN s > p THEN concat('CronJob ', n, ' has recent schedules without success. Last successful run: ',
          strftime(p, {_RFC}), ', last scheduled: ', strftime(s, {_RFC}), '.')
        WHEN user_id % 5 = 0 THEN concat('CronJob ', n, ' is currently suspended.')
        ELSE concat('CronJob ', n, ' is operating normally. Last successful run: ', strftime(p, {_RFC}), '.') END AS reason
    FROM x""",
)
def cron_health(t):
    def last(kind):
        return F.date_trunc("second", F.max(F.when(F.col("event_type") == kind, F.col("ts"))))

    runs = t.events.groupBy("user_id").agg(last("signup").alias("s"), last("purchase").alias("p"))
    found = health.cron_job_verdict(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")),
        F.col("s"),
        F.col("p"),
        F.when(F.col("user_id") % 3 == 0, F.lit(1209600)),
        F.col("user_id") % 5 == 0,
        F.lit("2024-02-05").cast("timestamp"),
    )
    return runs.withColumn("v", found).select("user_id", state_name(F.col("v.rank")).alias("state"), F.col("v.reason").alias("reason"))


@query(
    "state_severity",
    f"""SELECT CAST(rank AS INTEGER) AS rank, {STATE_SQL}[rank + 1] AS state, {SEVERITY_SQL}[rank + 1] AS severity, count(*) AS n
    FROM ({SQL_CONTAINERS}) GROUP BY rank""",
)
def state_severity(t):
    counted = containers(t).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("rank", state_name(F.col("rank")).alias("state"), severity(F.col("rank")).alias("severity"), "n")


# --------------------------------------------------------------------------- relations


def _services(t):
    parts = t.part.select("p_brand", "p_type", (F.col("p_size") % 2).alias("half")).distinct()
    pair = parts.select(
        F.concat_ws("|", "p_brand", "p_type", F.col("half").cast("string")).alias("service_uuid"),
        F.concat(F.lit("ns-"), F.col("half").cast("string")).alias("namespace"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("selector"),
    )
    single = parts.select("p_brand").distinct().select(
        F.col("p_brand").alias("service_uuid"),
        F.lit("ns-0").alias("namespace"),
        F.create_map(F.lit("brand"), F.col("p_brand")).alias("selector"),
    )
    never = parts.select("p_type").distinct().select(
        F.col("p_type").alias("service_uuid"),
        F.lit("ns-0").alias("namespace"),
        F.create_map(F.lit("type"), F.col("p_type"), F.lit("absent"), F.lit("x")).alias("selector"),
    )
    nothing = parts.select("p_type").distinct().select(  # without a selector, which selects nothing
        F.concat(F.lit("none-"), "p_type").alias("service_uuid"),
        F.lit("ns-0").alias("namespace"),
        F.map_filter(F.create_map(F.lit("type"), F.col("p_type")), lambda k, v: F.lit(False)).alias("selector"),
    )
    return pair.unionByName(single).unionByName(never).unionByName(nothing)


def _labelled_parts(t):
    return t.part.select(
        F.col("p_partkey").alias("pod_uuid"),
        F.concat(F.lit("ns-"), (F.col("p_size") % 2).cast("string")).alias("namespace"),
        F.create_map(
            F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("tier"), F.lit("shop")
        ).alias("labels"),
    )


@query(
    "selector_join",
    """SELECT p_brand || '|' || p_type || '|' || (p_size % 2) AS service_uuid, p_partkey AS pod_uuid FROM part
    UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size % 2 = 0""",
)
def selector_join(t):
    return relate.select_pods(_services(t), _labelled_parts(t))


@query(
    "selector_join_all_namespaces",
    """WITH s AS (SELECT DISTINCT p_brand, p_type, p_size % 2 AS half FROM part)
    SELECT s.p_brand || '|' || s.p_type || '|' || half AS service_uuid, p_partkey AS pod_uuid FROM s JOIN part USING (p_brand, p_type)
    UNION ALL SELECT p_brand, p_partkey FROM part""",
)
def selector_join_all_namespaces(t):
    return relate.select_pods(_services(t), _labelled_parts(t), same_namespace=False)


_ORPHAN_TAGS = "name, namespace, resource, uuid"


@query(
    "orphans",
    """WITH r AS (
      SELECT 'order-' || o_orderkey AS uuid, 'pod' AS resource, 'o' || o_orderkey AS name, 'shop' AS namespace, o_orderstatus AS cluster_uuid
      FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
      UNION ALL SELECT 'customer-' || c_custkey, 'replica_set', c_name, '', ''
      FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 0))
    SELECT uuid, resource AS kind, nullif(cluster_uuid, '') AS cluster_uuid,
      CASE WHEN namespace = '' THEN name ELSE namespace || '/' || name END AS name, 'ok' AS severity,
      'Automatically resolving the incident because of an orphaned resource.' AS message,
      '/' || replace(resource, '_', '') || '?id=' || uuid AS url,
      CASE WHEN cluster_uuid = '' THEN 4 ELSE 5 END AS tag_count FROM r""",
)
def orphans(t):
    def refs(uuid, resource, name, namespace, cluster):
        columns = {"uuid": uuid, "resource": F.lit(resource), "name": name, "namespace": F.lit(namespace), "cluster_uuid": cluster}
        return [c.alias(n) for n, c in columns.items()]

    order_id = F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))
    customer_id = F.concat(F.lit("customer-"), F.col("c_custkey").cast("string"))
    named = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    incidents = t.orders.select(*refs(order_id, "pod", named, "shop", F.col("o_orderstatus"))).unionByName(
        t.customer.select(*refs(customer_id, "replica_set", F.col("c_name"), "", F.lit("")))
    )
    live = {
        "pod": t.lineitem.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("uuid")),
        "replica_set": t.orders.where("o_orderkey % 10 = 0").select(F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("uuid")),
    }
    events = notify.orphan_events(relate.orphans(incidents, live))
    return events.select(
        "uuid", "kind", "cluster_uuid", "name", "severity", "message", "url", F.size("tags").alias("tag_count")
    )


@query(
    "orphans_by_kind",
    """SELECT resource, count(*) AS n FROM (
      SELECT 'pod' AS resource FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
      UNION ALL SELECT 'replica_set' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 10 = 0))
    GROUP BY resource""",
)
def orphans_by_kind(t):
    incidents = t.orders.select(F.lit("pod").alias("resource"), F.col("o_orderkey").alias("uuid")).unionByName(
        t.customer.select(F.lit("replica_set").alias("resource"), F.col("c_custkey").alias("uuid"))
    )
    live = {
        "pod": t.lineitem.select(F.col("l_orderkey").alias("uuid")),
        "replica_set": t.orders.where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("uuid")),
    }
    return relate.orphans(incidents, live).groupBy("resource").agg(F.count(F.lit(1)).alias("n"))


@query(
    "owner_closure",
    """WITH e AS (SELECT 'order-' || o_orderkey AS child, 'customer-' || o_custkey AS owner FROM orders
      UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey FROM customer
      UNION ALL SELECT 'nation-' || n_nationkey, 'region-' || n_regionkey FROM nation)
    SELECT child, owner AS ancestor, 1 AS distance FROM e
    UNION ALL SELECT a.child, b.owner, 2 FROM e a JOIN e b ON a.owner = b.child
    UNION ALL SELECT a.child, c.owner, 3 FROM e a JOIN e b ON a.owner = b.child JOIN e c ON b.owner = c.child""",
)
def owner_closure(t):
    def edges(table, child, child_kind, owner, owner_kind):
        def ident(kind, column):
            return F.concat(F.lit(f"{kind}-"), F.col(column).cast("string"))

        return table.select(ident(child_kind, child).alias("child"), ident(owner_kind, owner).alias("owner"))

    found = (
        edges(t.orders, "o_orderkey", "order", "o_custkey", "customer")
        .unionByName(edges(t.customer, "c_custkey", "customer", "c_nationkey", "nation"))
        .unionByName(edges(t.nation, "n_nationkey", "nation", "n_regionkey", "region"))
    )
    return relate.reachable(found)


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_RELATED_EDGES = """SELECT 'pod-' || o_orderkey AS child, 'set-' || o_custkey AS owner, 'owner' AS relation FROM orders
      UNION ALL SELECT 'set-' || c_custkey, 'deployment-' || c_nationkey, 'owner' FROM customer
      UNION ALL SELECT 'pod-' || o_orderkey, 'claim-' || c_custkey, 'claim' FROM orders JOIN customer ON c_custkey = o_custkey % 500 AND c_nationkey % 5 = o_orderkey % 5
      UNION ALL SELECT 'volume-' || c_custkey, 'claim-' || c_custkey, 'claim' FROM customer
      UNION ALL SELECT 'ingress-' || s_suppkey, 'service-' || p_partkey, 'backend' FROM supplier JOIN part ON p_partkey = s_suppkey * 3 AND s_nationkey % 2 = p_size % 2
      UNION ALL SELECT 'slice-' || p_partkey, 'pod-' || p_partkey, 'target' FROM part"""


def _related_tables(t) -> dict[str, DataFrame]:
    """Orders as pods, customers as their owners, claims and volumes, parts as services, suppliers as ingresses."""

    def named(table: DataFrame, kind: str, key: str, namespace: Column) -> DataFrame:
        return table.select(_text(f"{kind}-", F.col(key)).alias("uuid"), F.lit("c1").alias("cluster_uuid"), _text("ns-", namespace).alias("namespace"), _text("n-", F.col(key)).alias("name"))

    order, customer = F.col("o_orderkey"), F.col("c_custkey")
    return {
        "pod": named(t.orders, "pod", "o_orderkey", order % 5),
        "pvc": named(t.customer, "claim", "c_custkey", F.col("c_nationkey") % 5),
        "service": named(t.part, "service", "p_partkey", F.col("p_size") % 2),
        "ingress": named(t.supplier, "ingress", "s_suppkey", F.col("s_nationkey") % 2),
        "pod_owner": t.orders.select(_text("pod-", order).alias("pod_uuid"), _text("set-", F.col("o_custkey")).alias("owner_uuid")),
        "replica_set_owner": t.customer.select(_text("set-", customer).alias("replica_set_uuid"), _text("deployment-", F.col("c_nationkey")).alias("owner_uuid")),
        "pod_pvc": t.orders.select(_text("pod-", order).alias("pod_uuid"), _text("n-", F.col("o_custkey") % 500).alias("claim_name")),
        "persistent_volume_claim_ref": t.customer.select(_text("volume-", customer).alias("persistent_volume_uuid"), _text("claim-", customer).alias("uid")),
        "ingress_backend_service": t.supplier.select(_text("ingress-", F.col("s_suppkey")).alias("ingress_uuid"), _text("n-", F.col("s_suppkey") * 3).alias("service_name")),
        "endpoint_target_ref": t.part.select(_text("slice-", F.col("p_partkey")).alias("endpoint_slice_uuid"), _text("pod-", F.col("p_partkey")).alias("uid")),
    }


@query("object_edges", f"SELECT DISTINCT child, owner, relation FROM ({_RELATED_EDGES})")
def object_edges(t):
    return relate.object_edges(_related_tables(t), identify=lambda uid: uid)


@query(
    "related_objects",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT child, owner FROM ({_RELATED_EDGES})),
    r AS (SELECT child, owner AS ancestor, 1 AS distance FROM e UNION SELECT r.child, e.owner, r.distance + 1 FROM r JOIN e ON r.ancestor = e.child)
    SELECT child, ancestor, min(distance) AS distance FROM r GROUP BY 1, 2""",
)
def related_objects(t):
    """What every object leads to over owners, claims, backends and targets."""
    return relate.reachable(relate.object_edges(_related_tables(t), identify=lambda uid: uid))


# --------------------------------------------------------------------------- table maintenance


@query(
    "upsert_latest",
    """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def upsert_latest(t):
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    signups = F.col("event_type") == "signup"
    return merge.merge_latest(rows.where(signups), rows.where(~signups), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "apply_changes",
    f"""WITH all_rows AS (SELECT c_custkey AS user_id, TIMESTAMP '2023-01-01' AS ts, -1 AS event_id, c_acctbal AS value, 'UPDATED' AS op FROM customer
      UNION ALL SELECT user_id, ts, event_id, value, {OP} FROM events)
    SELECT user_id, event_id, value FROM (SELECT * FROM all_rows
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE op <> 'DELETED'""",
)
def apply_changes(t):
    current = t.customer.select(
        F.col("c_custkey").alias("user_id"),
        F.lit("2023-01-01").cast("timestamp").alias("ts"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.col("c_acctbal").alias("value"),
    )
    return merge.apply_changes(current, changes(t), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "split_changes",
    f"""SELECT op = 'DELETED' AS deleted, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT *, {OP} AS op FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1""",
)
def split_changes(t):
    upserts, deletes = merge.split_changes(merge.latest_per_key(changes(t), ["user_id"], ["ts", "event_id"]))
    both = upserts.withColumn("deleted", F.lit(False)).unionByName(deletes.withColumn("deleted", F.lit(True)))
    return both.groupBy("deleted").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(
    "partial_upsert",
    """WITH d AS (SELECT o_custkey + 500 AS c_custkey, 'new' AS c_name, CAST(0 AS INTEGER) AS c_nationkey, max(o_totalprice) AS c_acctbal,
        'NONE' AS c_mktsegment FROM orders GROUP BY o_custkey)
    SELECT coalesce(c.c_custkey, d.c_custkey) AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name ELSE d.c_name END AS c_name,
      CASE WHEN c.c_custkey IS NOT NULL THEN c.c_nationkey ELSE d.c_nationkey END AS c_nationkey,
      CASE WHEN d.c_custkey IS NOT NULL THEN d.c_acctbal ELSE c.c_acctbal END AS c_acctbal,
      CASE WHEN c.c_custkey IS NOT NULL THEN c.c_mktsegment ELSE d.c_mktsegment END AS c_mktsegment
    FROM customer c FULL JOIN d ON c.c_custkey = d.c_custkey""",
)
def partial_upsert(t):
    delta = (
        t.orders.groupBy((F.col("o_custkey") + 500).alias("c_custkey"))
        .agg(F.max("o_totalprice").alias("c_acctbal"))
        .withColumns({"c_name": F.lit("new"), "c_nationkey": F.lit(0), "c_mktsegment": F.lit("NONE")})
    )
    return merge.merge_partial(t.customer, delta, ["c_custkey"], ["c_acctbal"])


@query(
    "reconcile_delete",
    "SELECT o_orderkey AS uuid FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def reconcile_delete(t):
    stored = t.orders.select(F.col("o_orderkey").alias("uuid"))
    return merge.vanished(stored, t.lineitem.select(F.col("l_orderkey").alias("uuid")))


@query(
    "cascade_delete",
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
      gone_orders AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
    SELECT 'customer' AS tbl, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
    UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone_orders)""",
)
def cascade_delete(t):
    gone = t.customer.where(F.col("c_acctbal") < 0).select("c_custkey")
    gone_orders = merge.keep_keys(t.orders, gone, "o_custkey", "c_custkey")
    left = {
        "customer": (merge.delete_keys(t.customer, gone, "c_custkey"), "c_custkey"),
        "orders": (merge.delete_keys(t.orders, gone, "o_custkey", "c_custkey"), "o_orderkey"),
        "lineitem": (merge.delete_keys(t.lineitem, gone_orders, "l_orderkey", "o_orderkey"), "l_orderkey"),
    }
    parts = [
        rows.agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("tbl"), "n", "keys")
        for name, (rows, key) in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "containers_of_deleted_pods",
    """SELECT l_orderkey AS pod_uuid, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def containers_of_deleted_pods(t):
    gone = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("uuid"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("pod_uuid"), "l_linenumber", "l_partkey")
    return relate.containers_of(rows, gone)


@query(
    "retention",
    "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 DAY",
)
def retention(t):
    kept = merge.retain(t.events.select("event_id", "ts"), "ts", F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return kept.select("event_id", F.unix_millis("ts").alias("ts_ms"))


@query(
    "replace_prefix",
    """WITH old AS (SELECT p_brand AS cluster_uuid, p_type || '.' || p_partkey AS key, p_name AS value, p_size > 25 AS locked FROM part),
      new AS (SELECT 'Brand#2' AS cluster_uuid, 'ECONOMY.' || s_suppkey AS key, s_name AS value, TRUE AS locked FROM supplier)
    SELECT * FROM old WHERE NOT (cluster_uuid = 'Brand#2' AND starts_with(key, 'ECONOMY.') AND locked)
      AND NOT EXISTS (SELECT 1 FROM new WHERE new.key = old.key AND new.cluster_uuid = old.cluster_uuid)
    UNION ALL SELECT * FROM new""",
)
def replace_prefix(t):
    old = t.part.select(
        F.col("p_brand").alias("cluster_uuid"),
        F.concat("p_type", F.lit("."), F.col("p_partkey").cast("string")).alias("key"),
        F.col("p_name").alias("value"),
        (F.col("p_size") > 25).alias("locked"),
    )
    new = t.supplier.select(
        F.lit("Brand#2").alias("cluster_uuid"),
        F.concat(F.lit("ECONOMY."), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_name").alias("value"),
        F.lit(True).alias("locked"),
    )
    return merge.replace_prefix(old, new, F.lit("Brand#2"), "ECONOMY.")


@query(
    "insert_only",
    """SELECT user_id, event_id, value FROM (
      SELECT user_id, event_id, value, ts FROM events WHERE event_type <> 'error'
      UNION ALL SELECT user_id, event_id, value, ts + INTERVAL 1 DAY FROM events WHERE event_type = 'error' AND event_id % 3 = 0)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def insert_only(t):
    """Onto rows of which some are older and some newer than the changes."""
    stored = t.events.where((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0))
    stored = stored.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY")).select(*changes(t).drop("op").columns)
    return merge.insert_only(stored, changes(t), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    "vanishing_guard",
    """SELECT event_id FROM events WHERE event_type <> 'error' OR ts > TIMESTAMP '2024-01-15' + INTERVAL 30 SECOND""",
)
def vanishing_guard(t):
    rows = t.events.withColumn("gone_at", F.when(F.col("event_type") == "error", F.col("ts")))
    return merge.drop_vanishing(rows, F.lit("2024-01-15").cast("timestamp"), column="gone_at").select("event_id")


@query(
    "unused_entries",
    "SELECT p_partkey AS uuid, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)",
)
def unused_entries(t):
    dictionary = t.part.select(F.col("p_partkey").alias("uuid"), F.col("p_name").alias("name"))
    bridge = t.lineitem.where(F.col("l_quantity") > 48).select("l_partkey")
    return merge.unused_entries(dictionary, bridge, "l_partkey")


@query(
    "scan_table",
    "SELECT o_orderkey AS uuid, o_orderstatus AS cluster_uuid, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
)
def scan_table(t):
    stored = t.orders.withColumnsRenamed({"o_orderkey": "uuid", "o_orderstatus": "cluster_uuid"})
    return readers.scan_table(stored, ["uuid", "cluster_uuid", "o_totalprice"], F.lit("O"))


@query(
    "settings_pivot",
    """SELECT p_brand AS cluster_uuid, max(p_name) FILTER (p_type = 'ECONOMY') AS "ECONOMY", max(p_name) FILTER (p_type = 'PROMO') AS "PROMO",
      max(p_name) FILTER (p_type = 'STANDARD') AS "STANDARD" FROM part GROUP BY p_brand""",
)
def settings_pivot(t):
    rows = t.part.select(F.col("p_brand").alias("cluster_uuid"), F.col("p_type").alias("key"), F.col("p_name").alias("value"))
    return readers.settings(rows, keys=["ECONOMY", "PROMO", "STANDARD"])


# --------------------------------------------------------------------------- scalars

_QUANTITY_SQL = "concat(CAST(o_orderkey % 1000 AS {s}), CASE o_orderkey % 7 WHEN 0 THEN 'm' WHEN 1 THEN 'Mi' WHEN 2 THEN 'k' WHEN 3 THEN '' WHEN 4 THEN 'u' WHEN 5 THEN 'Ki' ELSE 'e3' END)"


@query(
    "scalar_functions",
    f"""WITH o AS (SELECT *, {_QUANTITY_SQL.format(s='VARCHAR')} AS q, CAST(o_orderkey % 25 + 8 AS INTEGER) AS bits FROM orders)
    SELECT o_orderkey,
      CAST(ceil(CAST(o_orderkey % 1000 AS DECIMAL(30,9)) * CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 1048576000 WHEN 2 THEN 1000000
        WHEN 3 THEN 1000 WHEN 4 THEN 0.001 WHEN 5 THEN 1024000 ELSE 1000000 END) AS BIGINT) AS milli,
      CASE WHEN 32 - bits >= 31 THEN -2 ELSE (1::BIGINT << (32 - bits)) - 2 END AS addresses,
      CASE o_orderkey % 4 WHEN 0 THEN 'node-' || o_custkey WHEN 1 THEN 'fd00::' || o_custkey WHEN 2 THEN 'node-' || o_custkey END AS host,
      lower(regexp_replace(replace(o_orderpriority, ' ', 'Set'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '.' ELSE o_orderpriority END AS stripped,
      CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderstatus || ': ' || o_orderpriority END AS reasoned,
      nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END, '') AS nulled,
      epoch_ms(date_trunc('minute', o_orderdate + to_seconds(o_orderkey % 100000))) AS minute_ms,
      strftime(o_orderdate, {_RFC}) AS rfc, '/replicaset?id=' || o_orderkey AS url,
      CASE WHEN o_orderstatus = 'O' THEN 'x' || o_custkey END AS replaced
    FROM o""",
)
def scalar_functions(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    third = key % 3 == 0
    instance = (
        F.when(key % 4 == 0, F.concat(F.lit("node-"), cust, F.lit(":9100")))
        .when(key % 4 == 1, F.concat(F.lit("[fd00::"), cust, F.lit("]:9100")))
        .when(key % 4 == 2, F.concat(F.lit("node-"), cust))
        .otherwise(F.concat(F.lit("fd00::"), cust, F.lit(":9100")))
    )
    priority = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        quantity.milli(F.expr(_QUANTITY_SQL.format(s="STRING"))).alias("milli"),
        quantity.usable_addresses(F.concat(F.lit("10.0.0.0/"), (key % 25 + 8).cast("string"))).alias("addresses"),
        text.host_of(instance).alias("host"),
        text.snake_case(F.replace(priority, F.lit(" "), F.lit("Set"))).alias("snake"),
        text.strip_stop(F.when(third, F.concat(F.lit(" \t"), priority, F.lit("..\n"))).otherwise(F.concat(priority, F.lit(". ")))).alias("stripped"),
        text.reason_and_message(F.col("o_orderstatus"), F.when(third, F.lit(" . ")).otherwise(F.concat(priority, F.lit(".")))).alias("reasoned"),
        text.nullable(F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))).alias("nulled"),
        F.unix_millis(F.date_trunc("minute", F.timestamp_seconds(F.unix_seconds("o_orderdate") + key % 100000))).alias("minute_ms"),
        text.rfc3339(F.col("o_orderdate")).alias("rfc"),
        text.url_path(F.lit("replica_set"), key.cast("string")).alias("url"),
        text.label_replace(F.concat("o_orderstatus", cust), "O(.*)", 1).alias("_r"),
    ).withColumn("replaced", F.concat(F.lit("x"), "_r")).drop("_r")


@query(
    "identifiers",
    f"""SELECT p_partkey, {sql_uuid5(OBJECT_SPACE, "'part-' || p_partkey")} AS derived,
      lower(concat(substr(m,1,8),'-',substr(m,9,4),'-',substr(m,13,4),'-',substr(m,17,4),'-',substr(m,21,12))) AS kept,
      {sql_uuid5(OBJECT_SPACE, "lower(p_name || ':' || p_brand)")} AS pair
    FROM (SELECT *, md5(p_name || p_partkey) AS m FROM part)""",
)
def identifiers(t):
    key = F.col("p_partkey").cast("string")
    digest = F.upper(F.md5(F.concat("p_name", key)))
    return t.part.select(
        "p_partkey",
        ids.ensure_uuid(F.concat(F.lit("part-"), key)).alias("derived"),
        ids.ensure_uuid(digest).alias("kept"),
        ids.pair_uuid(F.lit(ids.OBJECT_NAMESPACE), F.col("p_name"), F.col("p_brand")).alias("pair"),
    )


# --------------------------------------------------------------------------- logs

_TAIL_SQL = """WITH d AS (SELECT source, doc_id, text, octet_length(encode(text)) AS b FROM documents WHERE text <> ''),
    a AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS after,
      sum(b) OVER (PARTITION BY source)::BIGINT AS total FROM d),
    -- whole documents inside the tail, and the one document the tail starts in
    whole AS (SELECT source, string_agg(text, '' ORDER BY doc_id) AS body FROM a WHERE total <= 65535 OR after + b <= 65535 GROUP BY source),
    edge AS (SELECT source, text, 65535 - after AS room FROM a WHERE total > 65535 AND after < 65535 AND after + b > 65535),
    chars AS (SELECT source, c, i, room, sum(octet_length(encode(c))) OVER (PARTITION BY source ORDER BY i DESC) AS size
      FROM (SELECT source, room, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM edge)),
    part AS (SELECT source, string_agg(c, '' ORDER BY i) AS body FROM chars WHERE size <= room GROUP BY source),
    joined AS (SELECT s.source, s.total, concat(p.body, w.body) AS body FROM (SELECT DISTINCT source, total FROM a) s
      LEFT JOIN part p ON p.source = s.source LEFT JOIN whole w ON w.source = s.source)
    SELECT source, CASE WHEN total > 65535 AND instr(body, chr(10)) > 0 THEN substr(body, instr(body, chr(10)) + 1) ELSE body END AS logs FROM joined"""


@query("log_tail", _TAIL_SQL)
def log_tail(t):
    chunks = t.documents.select("source", "doc_id", "text")
    return logs.log_tails(chunks, ["source"], seq="doc_id")


@query("log_tail_sparse", _TAIL_SQL)
def log_tail_sparse(t):
    """Positions are times in nanoseconds, far apart and unevenly spread."""
    # One at an uneven place in every five seconds: such times end in 2262, which leaves room for a billion and a half of them.
    at = F.lit(1_700_000_000_000_000_000) + F.col("doc_id") * F.lit(5_000_015_000) + F.pmod(F.xxhash64("doc_id"), F.lit(5_000_000_000))
    return logs.log_tails(t.documents.select("source", at.alias("ns"), "text"), ["source"], seq="ns")


@query(
    "started_logs",
    """SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""",
)
def started_logs(t):
    chunks = t.documents.select(F.col("doc_id").alias("container_uuid"))
    started = t.labels.select(F.col("doc_id").alias("uuid"), (F.col("quality") == 1).alias("started"))
    return logs.wanted_chunks(chunks, started).select(F.col("container_uuid").alias("doc_id"))


# --------------------------------------------------------------------------- notifications


def _order_rows(t):
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("uuid"),
        F.col("o_orderstatus").alias("cluster_uuid"),
        F.lit("shop").alias("namespace"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("name"),
        state_name((F.col("o_orderkey") % 5).cast("int")).alias("health_state"),
        F.col("o_orderpriority").alias("health_reason"),
    )


@query(
    "notification_events",
    f"""SELECT o_orderkey::VARCHAR AS uuid, o_orderstatus AS cluster_uuid, 'daemon_set' AS kind, 'shop/order-' || o_orderkey AS name,
      {SEVERITY_SQL}[o_orderkey % 5 + 1] AS severity, o_orderpriority AS message, '/daemonset?id=' || o_orderkey AS url,
      'order-' || o_orderkey AS tag_name, 'shop' AS tag_namespace, 'daemon_set' AS tag_resource, o_orderstatus AS tag_cluster FROM orders""",
)
def notification_events(t):
    events = notify.health_events(_order_rows(t), "daemon_set")
    tags = {"tag_name": "name", "tag_namespace": "namespace", "tag_resource": "resource", "tag_cluster": "cluster_uuid"}
    return events.select(
        *[c for c in events.columns if c != "tags"], *[F.col("tags")[key].alias(name) for name, key in tags.items()]
    )


@query(
    "event_documents",
    f"""SELECT o_orderkey::VARCHAR AS uuid, concat('{{"name":"shop/order-', o_orderkey, '","severity":"', {SEVERITY_SQL}[o_orderkey % 5 + 1],
      '","message":"', o_orderpriority, '","url":"https://web/pod?id=', o_orderkey, '","tags":{{"uuid":"', o_orderkey, '","cluster_uuid":"', o_orderstatus,
      '","name":"order-', o_orderkey, '","namespace":"shop","resource":"pod"}},"extra_tags":null}}') AS value FROM orders""",
)
def event_documents(t):
    events = notify.health_events(_order_rows(t), "pod")
    return notify.event_json(events.withColumn("url", notify.absolute_url("https://web/")))


@query(
    "changed_events",
    """SELECT o_orderkey::VARCHAR AS uuid FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderkey % 5 = 4""",
)
def changed_events(t):
    now = _order_rows(t)
    calm = F.when(F.col("health_state") == "critical", "ok").otherwise(F.col("health_state"))
    other = F.when(F.col("health_reason").startswith("1"), "").otherwise(F.col("health_reason"))
    before = now.withColumn("health_state", calm).withColumn("health_reason", other)
    return notify.changed_events(notify.health_events(now, "pod"), notify.health_events(before, "pod")).select("uuid")


_RULES = [
    notify.Rule("all"),
    notify.Rule("big", "pod", "SELECT 1 FROM pod_item WHERE pod_item.order_uuid = ? AND pod_item.quantity > ?", (":uuid", 45)),
    notify.Rule("cluster", "pod", "SELECT 1 FROM pod_cluster c WHERE c.cluster_uuid = ? AND c.note <> 'what?'", (":cluster_uuid",)),
    notify.Rule("other-kind", "node", "SELECT 1 FROM pod_item WHERE order_uuid = ?", (":uuid",)),
    notify.Rule("broken", "pod", "SELECT 1 FROM missing_table WHERE uuid = ?", (":uuid",)),
]


@query(
    "rule_routing",
    """SELECT o_orderkey::VARCHAR AS uuid, concat_ws(',', 'all',
        CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) THEN 'big' END,
        CASE WHEN o_orderstatus IN (SELECT o_orderstatus FROM orders GROUP BY 1 HAVING max(o_totalprice) > 0 AND o_orderstatus <> 'P') THEN 'cluster' END) AS rule_ids
    FROM orders""",
)
def rule_routing(t):
    events = notify.health_events(_order_rows(t), "pod").select("uuid", "cluster_uuid", "kind")
    tables = {
        "pod_item": t.lineitem.select(F.col("l_orderkey").cast("string").alias("order_uuid"), F.col("l_quantity").alias("quantity")),
        "pod_cluster": t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderstatus").alias("cluster_uuid"), F.col("o_orderpriority").alias("note")),
    }
    routed, rejected = notify.match_rules(t.spark, events, _RULES, tables)
    assert list(rejected) == ["broken"]
    return routed.select("uuid", F.array_join("rule_ids", ",").alias("rule_ids"))


_RULE_ROWS = [
    ("always", ""),
    ("no-query", '{"version": 1, "kind": "pod"}'),
    ("no-kind", '{"version": 1, "query": "SELECT 1"}'),
    ("list", "[1]"),
    ("braces", '{"version": 1, "kind": "pod", "query": "SELECT 1 FROM pod_item WHERE order_uuid = ? AND \'a{b}\' <> \'{}\'", "args": [":uuid"]}'),
    ("zero", '{"version": 1, "kind": "pod", "query": "SELECT 1 FROM pod_item WHERE order_uuid = ? AND 1 / (quantity - quantity) > 0", "args": [":uuid"]}'),
    ("unknown", '{"version": 1, "kind": "pod", "query": "SELECT 1 FROM missing_table WHERE uuid = ?", "args": [":uuid"]}'),
    ("argument", '{"version": 1, "kind": "pod", "query": "SELECT 1 FROM pod_item WHERE order_uuid = ?"}'),
]


_LIMITS = 5_000  # rules per template


@query(
    "rule_routing_templates",
    f"""WITH r AS (SELECT i, 'over-' || i AS id, i % 50 AS quantity, i % 7 AS line FROM range({_LIMITS}) x(i)),
    hits AS (SELECT DISTINCT l_orderkey, id FROM lineitem JOIN r ON l_quantity > quantity AND l_linenumber = line
      UNION SELECT o_orderkey, 'status-' || i FROM orders JOIN range({_LIMITS}) x(i) ON o_orderstatus = ['F', 'O', 'P', 'X'][1 + i % 4] AND i % 100 = 0)
    SELECT o_orderkey::VARCHAR AS uuid, count(id) AS rules, coalesce(sum(hash_of), 0)::BIGINT AS ids
    FROM orders LEFT JOIN (SELECT l_orderkey, id, CAST(regexp_extract(id, '[0-9]+') AS BIGINT) AS hash_of FROM hits) ON l_orderkey = o_orderkey GROUP BY 1""",
)
def rule_routing_templates(t):
    """Many rules that differ in their arguments only; ones whose arguments do not fit the query are rejected singly."""
    events = notify.health_events(_order_rows(t), "pod").select("uuid", "cluster_uuid", "kind")
    tables = {
        "pod_item": t.lineitem.select(F.col("l_orderkey").cast("string").alias("order_uuid"), F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line")),
        "pod_state": t.orders.select(F.col("o_orderkey").cast("string").alias("uuid"), F.col("o_orderstatus").alias("status")),
    }

    def body(query: str, *args: Column) -> Column:
        given = F.concat_ws(",", F.lit('":uuid"'), *args)
        return F.concat(F.lit(f'{{"version": 1, "kind": "pod", "query": "{query}", "args": ['), given, F.lit("]}"))

    number = F.col("id")
    over = t.spark.range(_LIMITS).select(
        F.concat(F.lit("over-"), number.cast("string")).alias("id"),
        body("SELECT 1 FROM pod_item WHERE order_uuid = ? AND quantity > ? AND line = ?", (number % 50).cast("string"), (number % 7).cast("string")).alias("filter"),
    )
    states = F.array(*[F.lit(f'"{x}"') for x in "FOPX"])
    status = t.spark.range(0, _LIMITS, 100).select(
        F.concat(F.lit("status-"), number.cast("string")).alias("id"),
        body("SELECT 1 FROM pod_state WHERE uuid = ? AND status = ?", states[(number % 4).cast("int")]).alias("filter"),
    )
    # A template of two rules, one of which divides by zero.
    broken = t.spark.range(2).select(
        F.concat(F.lit("divide-"), number.cast("string")).alias("id"),
        body("SELECT 1 FROM pod_item WHERE order_uuid = ? AND quantity / ? < 0", number.cast("string")).alias("filter"),
    )
    rules = notify.judged_rules(over.unionByName(status).unionByName(broken))

    seen = []  # a dictionary of ids and their numbers

    def counted(rule_ids: pa.ListArray) -> pa.Array:
        """How many ids each event has, and the sum of their numbers; a number is read once per distinct id."""
        ends = rule_ids.offsets.to_numpy()
        coded = rule_ids.values
        if not seen or not seen[0].equals(coded.dictionary):
            numbers = pc.struct_field(pc.extract_regex(coded.dictionary, "(?P<n>[0-9]+)"), 0).cast(pa.int64())
            seen[:] = [coded.dictionary, numbers.to_numpy()]
        totals = np.concatenate([[0], np.cumsum(seen[1][coded.indices.to_numpy()])])[ends]
        return pa.StructArray.from_arrays([np.diff(ends).astype(np.int64), np.diff(totals)], ["rules", "ids"])

    routed, rejected = notify.match_rule_table(events, rules, tables, (counted, "struct<rules: bigint, ids: bigint>"))
    assert list(rejected) == ["divide-0"], rejected
    return routed.select("uuid", "rule_ids.rules", "rule_ids.ids")


@query(
    "rule_routing_errors",
    """SELECT o_orderkey::VARCHAR AS uuid, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'always,braces' ELSE 'always' END AS rule_ids,
      'argument,list,no-kind,no-query,unknown,zero' AS rejected FROM orders""",
)
def rule_routing_errors(t):
    """Rules that cannot be used are left out and named; the others still apply."""
    events = notify.health_events(_order_rows(t), "pod").select("uuid", "cluster_uuid", "kind")
    tables = {"pod_item": t.lineitem.select(F.col("l_orderkey").cast("string").alias("order_uuid"), F.col("l_quantity").alias("quantity"))}
    usable, unusable = notify.load_rules(t.spark.createDataFrame(_RULE_ROWS, "id STRING, filter STRING"))
    routed, failed = notify.match_rules(t.spark, events, usable, tables)
    names = ",".join(sorted({**unusable, **failed}))
    return routed.select("uuid", F.array_join("rule_ids", ",").alias("rule_ids"), F.lit(names).alias("rejected"))

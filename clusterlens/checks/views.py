"""The test tables in cluster roles.  Row by row: nothing here groups or joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Expressions both SQL dialects understand.
RANK = (
    "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 4 WHEN l_returnflag = 'R' THEN 3"
    " WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 2 WHEN l_returnflag = 'N' THEN 1 ELSE 0 END"
)
ROLE = "CASE l_linenumber WHEN 1 THEN 'init' WHEN 2 THEN 'sidecar' ELSE 'app' END"
RESOURCE_VALUES = {
    "cpu_limits": "CASE WHEN l_tax > 0 THEN CAST(l_quantity * 200 AS BIGINT) END",
    "cpu_requests": "CASE WHEN l_discount > 0 THEN CAST(l_quantity * 100 AS BIGINT) END",
    "memory_limits": "CASE WHEN l_tax > 0 THEN CAST(floor(l_extendedprice * 2) AS BIGINT) END",
    "memory_requests": "CASE WHEN l_discount > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END",
}
OP = "CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'error' THEN 'DELETED' ELSE 'UPDATED' END"


def containers(t) -> DataFrame:
    """Line items as containers of their order."""
    return t.lineitem.select(
        "l_orderkey",
        F.expr(RANK).alias("rank"),
        F.expr(ROLE).alias("role"),
        *[F.expr(e).alias(name) for name, e in RESOURCE_VALUES.items()],
    )


SQL_CONTAINERS = (
    f"SELECT l_orderkey, {RANK} AS rank, {ROLE} AS role, "
    + ", ".join(f"{e} AS {name}" for name, e in RESOURCE_VALUES.items())
    + " FROM lineitem"
)


def changes(t) -> DataFrame:
    """Events as a change log keyed by user."""
    return t.events.select("user_id", "ts", "event_id", "value", F.expr(OP).alias("op"))


def event_samples(t) -> DataFrame:
    """Events as samples of one gauge per event type and user."""
    return t.events.select(
        F.col("event_type").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        "ts",
        "value",
    )


# ------------------------------------------------------------------ samples for the metric library

# Start of the events, and the factor their time is compressed by so that a series is
# sampled about once a minute.
BASE_MS = 1_704_067_200_000
COMPRESSION = 600

# One row per event; expressions both SQL dialects understand.
EVENT_COLUMNS = {
    "node_no": "CAST(floor(user_id / 10) AS BIGINT)",
    "node": "concat('node-', CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR(20)))",
    "instance": "concat('10.0.0.', CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR(20)), ':9100')",
    "node_instance": "concat('node-', CAST(CAST(floor(user_id / 10) AS BIGINT) AS VARCHAR(20)))",
    "namespace": "concat('ns-', CAST(user_id % 5 AS VARCHAR(20)))",
    "pod": "concat('pod-', CAST(user_id AS VARCHAR(20)))",
    "container": "CASE WHEN event_type IN ('click', 'view') THEN 'main' ELSE 'helper' END",
    "resource": "CASE WHEN event_type IN ('click', 'error') THEN 'cpu' ELSE 'memory' END",
    "phase": "CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'Pending' WHEN 'error' THEN 'Failed'"
    " WHEN 'signup' THEN 'Succeeded' ELSE 'Unknown' END",
    "qos_class": "CASE event_type WHEN 'click' THEN 'Guaranteed' WHEN 'view' THEN 'Burstable' ELSE 'BestEffort' END",
    "device": "CASE event_type WHEN 'click' THEN 'eth0' WHEN 'view' THEN 'eth1' WHEN 'error' THEN 'veth12'"
    " WHEN 'signup' THEN 'lxc7' ELSE 'lo' END",
    "mountpoint": "CASE WHEN event_type IN ('click', 'view') THEN '/' ELSE '/data' END",
    "cpu": "CASE WHEN event_type IN ('click', 'error') THEN '0' ELSE '1' END",
    "mode": "CASE event_type WHEN 'click' THEN 'user' WHEN 'view' THEN 'system' WHEN 'error' THEN 'idle'"
    " WHEN 'signup' THEN 'iowait' ELSE 'nice' END",
}

_COUNTER = "CAST((t - 1704067200000) % 900000 AS DOUBLE) / 1000 * (1 + node_no % 7)"
_CORES = "CAST(4 + node_no % 4 AS DOUBLE)"

# Metric -> labels and value.
SAMPLES: dict[str, tuple[tuple[str, ...], str]] = {
    "kube_node_info": (("node",), "CAST(1 AS DOUBLE)"),
    "kube_namespace_created": (("namespace",), "value"),
    "kube_pod_status_phase": (("namespace", "pod", "phase"), "CAST(1 AS DOUBLE)"),
    "kube_pod_status_qos_class": (("namespace", "pod", "qos_class"), "CAST(1 AS DOUBLE)"),
    "node_cpu_seconds_total": (("instance", "node", "cpu", "mode"), _COUNTER),
    "node_memory_MemTotal_bytes": (("instance", "node"), "value + 1000"),
    "node_memory_MemAvailable_bytes": (("instance", "node"), "value"),
    "node_network_receive_bytes_total": (("node", "device"), _COUNTER),
    "node_network_transmit_bytes_total": (("node", "device"), f"2 * ({_COUNTER})"),
    "node_filesystem_avail_bytes": (("node", "mountpoint"), "value"),
    "node_filesystem_size_bytes": (("node", "mountpoint"), "value + 500"),
    "container_cpu_usage_seconds_total": (("instance", "namespace", "pod"), _COUNTER),
    "container_memory_usage_bytes": (("instance", "namespace", "pod"), "value"),
    "kube_pod_container_resource_requests": (("resource", "node", "namespace", "pod", "container"), "value"),
    "kube_pod_container_resource_limits": (("resource", "node", "namespace", "pod", "container"), "value * 2"),
    "machine_cpu_cores": (("node",), _CORES),
    "machine_memory_bytes": (("node",), f"1000 * {_CORES}"),
}

# Container memory is scraped through the node's own name, as its ratio needs it.
_RENAMED = {"container_memory_usage_bytes": {"instance": "node_instance"}}


def metric_samples(t, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """Samples of the given metrics, or of all."""
    found = None
    rows = t.events.select(
        "value",
        (F.floor((F.unix_millis("ts") - F.lit(BASE_MS)) / F.lit(COMPRESSION)) + F.lit(BASE_MS)).cast("bigint").alias("t"),
        *[F.expr(e.replace("VARCHAR(20)", "STRING")).alias(name) for name, e in EVENT_COLUMNS.items()],
    )
    for metric, (labels, value) in SAMPLES.items():
        if metrics is not None and metric not in metrics:
            continue
        renamed = _RENAMED.get(metric, {})
        pairs = [x for name in labels for x in (F.lit(name), F.col(renamed.get(name, name)))]
        part = rows.select(
            F.lit(metric).alias("metric"),
            F.create_map(*pairs).alias("labels"),
            F.timestamp_millis("t").alias("ts"),
            F.expr(value).alias("value"),
        )
        found = part if found is None else found.unionByName(part)
    return found


def sql_metric(metric: str) -> str:
    """The same samples in SQL, one column per label."""
    labels, value = SAMPLES[metric]
    renamed = _RENAMED.get(metric, {})
    columns = ", ".join(f"{EVENT_COLUMNS[renamed.get(name, name)]} AS {name}" for name in labels)
    inner = (
        f"SELECT *, {EVENT_COLUMNS['node_no']} AS node_no,"
        f" {BASE_MS} + (epoch_us(ts) // 1000 - {BASE_MS}) // {COMPRESSION} AS t FROM events"
    )
    return f"SELECT {columns}, t, {value} AS v FROM ({inner})"

"""Projections of all kinds of objects.

Each kind's documents are made from the rows of a table, one document per row, and go
through the same JSON parsing as a snapshot that is read from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from clusterlens.checks.base import OBJECT_SPACE, query, sql_uuid5
from clusterlens.plans.registry import kinds
from clusterlens.plans.storage import cluster_row
from clusterlens.sources.readers import parse_objects

CLUSTER = "cluster-1"
NOW = "1998-01-01"


def flat(rows: DataFrame) -> DataFrame:
    """Times as epoch milliseconds, without the source document."""
    columns = [
        F.unix_millis(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in rows.schema.fields
        if f.name != "document"
    ]
    return rows.select(*columns)


def objects(table: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """Objects of a kind from SQL expressions of their top-level fields."""
    document = F.to_json(F.struct(*[F.expr(e).alias(name) for name, e in fields.items()]))
    return parse_objects(table.select(document.alias("raw")), kind)


def table_of(kind: str, documents: DataFrame, table: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    known = kinds()[kind]
    return flat(known.table(table, known.prepared(documents, F.lit(CLUSTER), now), now))


def metadata(prefix: str, key: str, extra: str = "") -> str:
    return (
        f"named_struct('uid', concat('{prefix}-', {key}), 'name', concat('{prefix}-', {key}), 'namespace', concat('ns-', {key} % 7),"
        f" 'resourceVersion', CAST({key} AS STRING), 'creationTimestamp', TIMESTAMP '2024-01-01 00:00:00'{extra})"
    )


def header_sql(prefix: str, key: str, created: str = "1704067200000") -> str:
    return (
        f"{uid_sql(prefix, key)} AS uuid, '{CLUSTER}' AS cluster_uuid, '{prefix}-' || {key} AS uid, 'ns-' || ({key} % 7) AS namespace,"
        f" '{prefix}-' || {key} AS name, {key}::VARCHAR AS resource_version, {created} AS created"
    )


def uid_sql(prefix: str, key: str) -> str:
    return sql_uuid5(OBJECT_SPACE, f"'{prefix}-' || {key}")


def register(kind: str, source: str, fields: dict[str, str], tables: dict[str, str]) -> None:
    """One query per table of the kind: ``object_<table>`` or ``object_<table>_of_<kind>``."""
    for table, sql in tables.items():
        name = f"object_{table}" if table.startswith(kind) or kind == "pod" else f"object_{table}_of_{kind}"

        def run(t, table=table):
            return table_of(kind, objects(getattr(t, source), kind, fields), table)

        query(name, sql)(run)


# --------------------------------------------------------------------------- pods

_K = "o_orderkey"
_STATE = f"""CASE WHEN {_K} % 8 = 7 THEN NULL ELSE named_struct(
    'waiting', CASE WHEN {_K} % 8 = 6 THEN named_struct('reason', element_at(array('', 'PodInitializing', 'ContainerCreating', 'ErrImagePull', 'CrashLoopBackOff'), CAST({_K} % 5 + 1 AS INT)),
        'message', 'back-off..') END,
    'running', CASE WHEN {_K} % 8 BETWEEN 3 AND 5 THEN named_struct('startedAt', o_orderdate) END,
    'terminated', CASE WHEN {_K} % 8 < 3 THEN named_struct('exitCode', CAST({_K} % 8 AS INT), 'signal', CASE WHEN {_K} % 8 = 1 THEN 9 ELSE 0 END,
        'reason', CASE WHEN {_K} % 8 = 1 THEN 'OOMKilled' ELSE 'Error' END, 'message', CASE WHEN {_K} % 8 = 1 THEN ' mem. ' ELSE '' END, 'finishedAt', o_orderdate) END) END"""
_LAST = f"""CASE WHEN {_K} % 10 < 5 THEN named_struct('terminated', named_struct('exitCode', 3, 'signal', 0,
    'reason', CASE WHEN {_K} % 20 < 3 THEN 'ImagePullBackOff' ELSE 'Error' END, 'message', 'last..', 'finishedAt', o_orderdate)) END"""
_MAIN = f"""named_struct('name', 'main', 'image', concat('img:', {_K} % 10), 'imagePullPolicy', 'IfNotPresent',
    'readinessProbe', CASE WHEN {_K} % 2 = 0 THEN named_struct('port', 1) END, 'startupProbe', CASE WHEN {_K} % 3 = 0 THEN named_struct('port', 1) END,
    'resources', named_struct('requests', map('cpu', concat({_K} % 5 * 100, 'm'), 'memory', concat({_K} % 4, 'Mi')), 'limits', map('cpu', CAST({_K} % 3 AS STRING))),
    'volumeMounts', array(named_struct('name', 'data', 'mountPath', '/data', 'subPath', '', 'readOnly', {_K} % 2 = 0),
      named_struct('name', 'data', 'mountPath', '/sub', 'subPath', 'sub', 'readOnly', CAST(NULL AS BOOLEAN))),
    'volumeDevices', CASE WHEN {_K} % 9 = 0 THEN array(named_struct('name', 'dev', 'devicePath', '/dev/x')) END)"""
_SETUP = """named_struct('name', 'setup', 'image', 'init', 'imagePullPolicy', 'Always', 'restartPolicy', CAST(NULL AS STRING),
    'resources', named_struct('requests', map('cpu', '250m'), 'limits', map('ephemeral', '1')))"""
_PROXY = """named_struct('name', 'proxy', 'image', 'proxy', 'imagePullPolicy', 'Always', 'restartPolicy', 'Always',
    'resources', named_struct('requests', map('none', '1'), 'limits', map('memory', '1Gi')))"""


def _condition(kind: str, status: str, reason: str = "R", message: str = "m.") -> str:
    return (
        f"named_struct('type', '{kind}', 'status', '{status}', 'reason', '{reason}', 'message', '{message}',"
        " 'lastProbeTime', CAST(NULL AS TIMESTAMP), 'lastTransitionTime', o_orderdate)"
    )


_POD_CONDITIONS = f"""CASE CAST({_K} % 6 AS INT) WHEN 1 THEN array({_condition('PodScheduled', 'False', 'Unschedulable', 'no nodes')})
    WHEN 2 THEN array({_condition('Initialized', 'True')}, {_condition('Ready', 'False')})
    WHEN 3 THEN array({_condition('DisruptionTarget', 'True', 'Preempt', 'by x.')})
    WHEN 4 THEN array({_condition('PodReadyToStartContainers', 'False')})
    WHEN 5 THEN array({_condition('Ready', 'False')}, {_condition('Ready', 'True')}) END"""

_POD = {
    "metadata": f"""named_struct('uid', concat('order-', {_K}), 'name', concat('pod-', {_K}), 'namespace', concat('ns-', {_K} % 7),
      'resourceVersion', CAST({_K} AS STRING), 'creationTimestamp', o_orderdate,
      'deletionTimestamp', CASE WHEN {_K} % 19 = 0 THEN o_orderdate END,
      'deletionGracePeriodSeconds', CASE WHEN {_K} % 38 = 0 THEN 0 WHEN {_K} % 19 = 0 THEN 3600 END,
      'labels', map('App', concat('app-', o_custkey % 50), 'tier', o_orderstatus), 'annotations', map('note', o_orderpriority),
      'ownerReferences', CASE WHEN {_K} % 3 = 0 THEN array(named_struct('uid', concat('customer-', o_custkey), 'kind', 'ReplicaSet',
        'name', concat('rs-', o_custkey), 'controller', true)) END)""",
    "spec": f"""named_struct('nodeName', CASE WHEN {_K} % 11 = 0 THEN '' ELSE concat('node-', {_K} % 100) END, 'restartPolicy', 'Always',
      'containers', array({_MAIN}), 'initContainers', CASE WHEN {_K} % 4 = 0 THEN array({_PROXY}, {_SETUP}) ELSE array({_SETUP}) END,
      'volumes', array(from_json(concat('{{"name":"data","persistentVolumeClaim":{{"claimName":"claim-', {_K}, '","readOnly":true}}}}'),
          'name STRING, persistentVolumeClaim STRUCT<claimName: STRING, readOnly: BOOLEAN>, emptyDir STRUCT<medium: STRING>, nfs STRUCT<server: STRING>'),
        from_json('{{"name":"tmp","emptyDir":{{"medium":"Memory"}}}}',
          'name STRING, persistentVolumeClaim STRUCT<claimName: STRING, readOnly: BOOLEAN>, emptyDir STRUCT<medium: STRING>, nfs STRUCT<server: STRING>'),
        from_json('{{"name":"share","nfs":{{"server":"s"}}}}',
          'name STRING, persistentVolumeClaim STRUCT<claimName: STRING, readOnly: BOOLEAN>, emptyDir STRUCT<medium: STRING>, nfs STRUCT<server: STRING>')))""",
    "status": f"""named_struct('phase', CASE WHEN {_K} % 23 = 0 THEN 'Succeeded' WHEN o_orderstatus = 'F' THEN 'Failed' WHEN o_orderstatus = 'O' THEN 'Running' ELSE 'Pending' END,
      'reason', CASE WHEN {_K} % 13 = 0 THEN 'Evicted' WHEN {_K} % 17 = 0 THEN 'NodeLost' END, 'message', ' msg. ', 'podIP', concat('10.1.0.', {_K} % 250),
      'qosClass', 'Burstable', 'conditions', {_POD_CONDITIONS},
      'containerStatuses', CASE WHEN {_K} % 8 <> 7 THEN array(named_struct('name', 'main', 'ready', {_K} % 8 = 3, 'started', {_K} % 8 IN (3, 5), 'restartCount', CAST({_K} % 4 AS INT),
        'state', {_STATE}, 'lastState', {_LAST})) END,
      'initContainerStatuses', array(named_struct('name', 'setup', 'ready', true, 'started', false, 'restartCount', 0, 'state', named_struct('terminated', named_struct('exitCode', 0, 'finishedAt', o_orderdate))),
        named_struct('name', 'proxy', 'ready', true, 'started', true, 'restartCount', 2, 'state', named_struct('terminated', CAST(NULL AS STRUCT<exitCode: INT, finishedAt: TIMESTAMP>)))))""",
}

_TIME = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S +0000 UTC')"
# One row per container of the pods, classified in SQL.
_CONTAINERS_SQL = f"""
    SELECT o.*, uuid AS pod_uuid, c.* FROM (SELECT *, {uid_sql('order', _K)} AS uuid, CAST({_K} AS BIGINT) AS k FROM orders) o,
    LATERAL (
      SELECT 0 AS ord, 'init' AS role, 'setup' AS name, 0 AS rank, 'Container setup terminated successfully at ' || {_TIME} || '.' AS reason,
        NULL::BIGINT AS cpu_limits, 250::BIGINT AS cpu_requests, NULL::BIGINT AS memory_limits, NULL::BIGINT AS memory_requests
      UNION ALL SELECT 1, 'sidecar', 'proxy', 2, 'Container proxy is unknown as its state could not be obtained: No state provided.',
        NULL, NULL, 1073741824000, NULL WHERE k % 4 = 0
      UNION ALL SELECT 2, 'app', 'main',
        CASE WHEN k % 8 = 7 THEN 2
          WHEN k % 8 < 3 AND k % 2 = 0 AND k % 10 < 5 THEN 4 WHEN k % 8 = 0 THEN 0 WHEN k % 8 < 3 THEN 4
          WHEN k % 8 = 3 THEN 0 WHEN k % 8 = 4 THEN (CASE WHEN k % 3 = 0 AND k % 10 < 5 THEN 4 ELSE 1 END)
          WHEN k % 8 = 5 THEN (CASE WHEN k % 2 = 0 AND k % 10 < 5 THEN 4 ELSE 1 END)
          WHEN k % 5 < 3 THEN 1 WHEN k % 5 = 3 THEN (CASE WHEN k % 20 < 3 THEN 4 ELSE 3 END) ELSE 4 END,
        CASE WHEN k % 8 = 7 THEN 'Container main is unknown as its state could not be obtained: No state provided.'
          WHEN (k % 8 < 3 AND k % 2 = 0 AND k % 10 < 5) OR (k % 8 = 4 AND k % 3 = 0 AND k % 10 < 5) OR (k % 8 = 5 AND k % 2 = 0 AND k % 10 < 5)
            THEN concat('Container main is critical as it''s not ready due to failing ', CASE WHEN k % 8 = 4 THEN 'startup' ELSE 'readiness' END,
              ' probes. Last terminal with non-zero exit code 3 and signal 0 was at ', {_TIME}, '. ', CASE WHEN k % 20 < 3 THEN 'ImagePullBackOff' ELSE 'Error' END, ': last..')
          WHEN k % 8 = 0 THEN 'Container main terminated successfully at ' || {_TIME} || '.'
          WHEN k % 8 = 1 THEN 'Container main terminated with signal 9 at ' || {_TIME} || '. OOMKilled: mem.'
          WHEN k % 8 = 2 THEN 'Container main terminated with non-zero exit code 2 at ' || {_TIME} || '. Error.'
          WHEN k % 8 = 3 THEN 'Container main is running since ' || {_TIME} || '.'
          WHEN k % 8 IN (4, 5) THEN 'Container main is pending.'
          WHEN k % 5 = 0 THEN 'Container main is pending as it''s waiting to be started.'
          WHEN k % 5 = 1 THEN 'Container main is pending as the Pod it''s running on is initializing.'
          WHEN k % 5 = 2 THEN 'Container main is pending as it''s still being created.'
          WHEN k % 5 = 3 AND k % 20 < 3 THEN 'Container main cannot start. ImagePullBackOff: last.'
          WHEN k % 5 = 3 THEN 'Container main is waiting to start as its image cannot be pulled: back-off...'
          ELSE 'Container main cannot start. CrashLoopBackOff: back-off.' END,
        nullif(k % 3 * 1000, 0), nullif(k % 5 * 100, 0), NULL, nullif(k % 4 * 1048576000, 0)
    ) c"""
_STATES = "['ok','pending','unknown','warning','critical']"


def _pod_sql() -> str:
    say = "'Pod ns-' || (k % 7) || '/pod-' || k"
    needs = ", ".join(
        f"CAST(greatest(sum({r}) FILTER (role = 'app'), max({r}) FILTER (role <> 'app')) AS BIGINT) AS {r}"
        for r in ("cpu_limits", "cpu_requests", "memory_limits", "memory_requests")
    )
    shut = "(k % 38 = 0 OR (k % 19 = 0 AND TIMESTAMP '1998-01-01' > o_orderdate + INTERVAL 1 HOUR))"
    evicted = "(phase = 'Failed' AND reason = 'Evicted')"
    return f"""WITH c AS ({_CONTAINERS_SQL}),
    p AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'Succeeded' WHEN o_orderstatus = 'F' THEN 'Failed' WHEN o_orderstatus = 'O' THEN 'Running' ELSE 'Pending' END AS phase,
        CASE WHEN k % 13 = 0 THEN 'Evicted' WHEN k % 17 = 0 THEN 'NodeLost' END AS reason FROM (
      SELECT k, uuid, o_orderdate, o_orderstatus, CAST(max(rank) AS INTEGER) AS worst, string_agg('[' || upper({_STATES}[rank + 1]) || '] ' || c.reason, chr(10) ORDER BY ord) AS reasons,
        count(*) FILTER (rank > 0) AS bad, count(*) FILTER (role <> 'init') AS total, {needs} FROM c GROUP BY k, uuid, o_orderdate, o_orderstatus)),
    v AS (SELECT *, CASE WHEN reason IS NOT DISTINCT FROM 'NodeLost' THEN 2 WHEN {shut} THEN 0 WHEN {evicted} THEN 4 WHEN k % 6 = 3 THEN 4 WHEN phase = 'Succeeded' THEN 0
        WHEN k % 6 = 1 THEN 4 WHEN phase = 'Failed' THEN worst WHEN k % 6 = 4 THEN 4 ELSE worst END AS rank,
      CASE WHEN reason IS NOT DISTINCT FROM 'NodeLost' THEN {say} || ' is unknown as the node which was running the pod is unresponsive.'
        WHEN {shut} THEN {say} || ' is being deleted at ' || {_TIME} || '.'
        WHEN {evicted} THEN {say} || ' is terminal: Evicted: msg.' WHEN k % 6 = 3 THEN {say} || ' is terminal: Preempt: by x.'
        WHEN phase = 'Succeeded' THEN {say} || ' is succeeded as all its containers have been terminated successfully and will not be restarted.'
        WHEN k % 6 = 1 THEN {say} || ' cannot be scheduled: Unschedulable: no nodes.'
        WHEN phase = 'Failed' THEN {say} || ' has failed as all its containers have been terminated and will not be restarted.' || chr(10) || reasons
        WHEN k % 6 = 4 THEN {say} || ' is not ready to start containers.'
        WHEN k % 6 = 2 THEN {say} || ' is ' || {_STATES}[worst + 1] || '.' || chr(10) || reasons
        ELSE {say} || ' is ' || {_STATES}[worst + 1] || ' with ' || (total - bad) || ' out of ' || total || ' containers running.' || chr(10) || reasons END AS why FROM p)
    SELECT uuid, '{CLUSTER}' AS cluster_uuid, 'order-' || k AS uid, 'ns-' || (k % 7) AS namespace, 'pod-' || k AS name, k::VARCHAR AS resource_version,
      epoch_us(o_orderdate) // 1000 AS created, CASE WHEN k % 11 <> 0 THEN 'node-' || (k % 100) END AS node_name, NULL::VARCHAR AS nominated_node_name,
      '10.1.0.' || (k % 250) AS ip, phase, {_STATES}[rank + 1] AS health_state, why AS health_reason, cpu_limits, cpu_requests, memory_limits, memory_requests,
      reason, ' msg. ' AS message, 'Burstable' AS qos, 'Always' AS restart_policy FROM v"""


def _container_sql(role: str) -> str:
    extra = ""
    if role != "init":
        values = ("k % 8 = 3", "k % 8 IN (3, 5)", "CASE WHEN k % 8 = 7 THEN 0 ELSE CAST(k % 4 AS INTEGER) END") if role == "app" else ("TRUE", "TRUE", "2")
        extra = ", " + ", ".join(f"{v} AS {n}" for v, n in zip(values, ("ready", "started", "restart_count")))
    image = {"init": "'init'", "sidecar": "'proxy'", "app": "'img:' || (k % 10)"}[role]
    policy = "'IfNotPresent'" if role == "app" else "'Always'"
    state = {
        "init": "'Terminated'",
        "sidecar": "NULL::VARCHAR",
        "app": "CASE WHEN k % 8 < 3 THEN 'Terminated' WHEN k % 8 < 6 THEN 'Running' WHEN k % 8 = 6 THEN 'Waiting' END",
    }[role]
    stamp = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')"
    details = {
        "init": f"'{{\"exitCode\":0,\"finishedAt\":\"' || {stamp} || '\"}}'",
        "sidecar": "NULL::VARCHAR",
        "app": f"""CASE WHEN k % 8 < 3 THEN concat('{{"exitCode":', k % 8, ',"signal":', CASE WHEN k % 8 = 1 THEN 9 ELSE 0 END, ',"reason":"', CASE WHEN k % 8 = 1 THEN 'OOMKilled' ELSE 'Error' END,
            '","message":"', CASE WHEN k % 8 = 1 THEN ' mem. ' ELSE '' END, '","finishedAt":"', {stamp}, '"}}')
          WHEN k % 8 < 6 THEN concat('{{"startedAt":"', {stamp}, '"}}')
          WHEN k % 8 = 6 THEN concat('{{"reason":"', ['', 'PodInitializing', 'ContainerCreating', 'ErrImagePull', 'CrashLoopBackOff'][k % 5 + 1], '","message":"back-off.."}}') END""",
    }[role]
    return f"""WITH c AS ({_CONTAINERS_SQL}) SELECT {sql_uuid5('pod_uuid', 'name')} AS uuid, pod_uuid, name, {image} AS image, {policy} AS image_pull_policy,
      {state} AS state, {details} AS state_details, {_STATES}[rank + 1] AS health_state, reason AS health_reason, cpu_limits, cpu_requests, memory_limits, memory_requests{extra}
    FROM c WHERE role = '{role}'"""


_POD_UUID = uid_sql("order", _K)
_MAIN_UUID = sql_uuid5("pod_uuid", "'main'")


def _pair_sql(table: str, key: str, owner: str, entries: list[tuple[str, str]], columns: str) -> str:
    """Rows of a map of named entries: ``columns`` may use owner, uuid, name and value."""
    parts = " UNION ALL ".join(f"SELECT {owner} AS owner, '{n}' AS name, {v} AS value FROM {table}" for n, v in entries)
    return f"SELECT {columns} FROM (SELECT *, {sql_uuid5('owner', 'lower(name || chr(58) || value)')} AS uuid FROM ({parts}))"


_POD_LABELS = [("App", "'app-' || (o_custkey % 50)"), ("tier", "o_orderstatus")]
_POD_NOTES = [("note", "o_orderpriority")]

register(
    "pod",
    "orders",
    _POD,
    {
        "pod": _pod_sql(),
        "container": _container_sql("app"),
        "init_container": _container_sql("init"),
        "sidecar_container": _container_sql("sidecar"),
        "container_device": f"SELECT {_MAIN_UUID} AS container_uuid, pod_uuid, 'dev' AS name, '/dev/x' AS path FROM (SELECT {_POD_UUID} AS pod_uuid FROM orders WHERE {_K} % 9 = 0)",
        "container_mount": f"""SELECT {_MAIN_UUID} AS container_uuid, pod_uuid, 'data' AS volume_name, path, sub_path, read_only FROM (
            SELECT {_POD_UUID} AS pod_uuid, '/data' AS path, NULL AS sub_path, {_K} % 2 = 0 AS read_only FROM orders
            UNION ALL SELECT {_POD_UUID}, '/sub', 'sub', FALSE FROM orders)""",
        "pod_condition": f"""SELECT {_POD_UUID} AS pod_uuid, type, status, NULL::BIGINT AS last_probe, epoch_us(o_orderdate) // 1000 AS last_transition, reason, message FROM orders JOIN (VALUES
            (1, 'PodScheduled', 'false', 'Unschedulable', 'no nodes'), (2, 'Initialized', 'true', 'R', 'm.'), (2, 'Ready', 'false', 'R', 'm.'), (3, 'DisruptionTarget', 'true', 'Preempt', 'by x.'),
            (4, 'PodReadyToStartContainers', 'false', 'R', 'm.'), (5, 'Ready', 'false', 'R', 'm.'), (5, 'Ready', 'true', 'R', 'm.')) c(n, type, status, reason, message) ON n = {_K} % 6""",
        "pod_owner": f"""SELECT {_POD_UUID} AS pod_uuid, {uid_sql('customer', 'o_custkey')} AS owner_uuid, 'replica_set' AS kind, 'rs-' || o_custkey AS name, 'customer-' || o_custkey AS uid,
            TRUE AS controller, FALSE AS block_owner_deletion FROM orders WHERE {_K} % 3 = 0""",
        "label": _pair_sql("orders", _K, _POD_UUID, _POD_LABELS, "uuid, name, value"),
        "pod_label": _pair_sql("orders", _K, _POD_UUID, _POD_LABELS, "owner AS pod_uuid, uuid AS label_uuid"),
        "resource_label": _pair_sql("orders", _K, _POD_UUID, _POD_LABELS, "owner AS resource_uuid, uuid AS label_uuid"),
        "annotation": _pair_sql("orders", _K, _POD_UUID, _POD_NOTES, "uuid, name, value"),
        "pod_annotation": _pair_sql("orders", _K, _POD_UUID, _POD_NOTES, "owner AS pod_uuid, uuid AS annotation_uuid"),
        "resource_annotation": _pair_sql("orders", _K, _POD_UUID, _POD_NOTES, "owner AS resource_uuid, uuid AS annotation_uuid"),
        "pod_pvc": f"SELECT {_POD_UUID} AS pod_uuid, 'data' AS volume_name, 'claim-' || {_K} AS claim_name, TRUE AS read_only FROM orders",
        "pod_volume": f"""SELECT {_POD_UUID} AS pod_uuid, 'tmp' AS volume_name, 'EmptyDir' AS type, '{{"medium":"Memory"}}' AS source FROM orders
            UNION ALL SELECT {_POD_UUID}, 'share', 'NFS', '{{"server":"s"}}' FROM orders""",
    },
)


# --------------------------------------------------------------------------- nodes

_C = "c_custkey"
_NODE_UUID = uid_sql("node", _C)
_NODE_CONDITION = "named_struct('type', '{}', 'status', '{}', 'lastHeartbeatTime', TIMESTAMP '2024-01-02 00:00:00', 'lastTransitionTime', TIMESTAMP '2024-01-03 00:00:00', 'reason', 'r')"
_NODE_CONDITIONS = {
    0: [("Ready", "True")],
    1: [("DiskPressure", "True"), ("Ready", "Unknown")],
    2: [("Ready", "Unknown"), ("MemoryPressure", "True"), ("PIDPressure", "False")],
    3: [("Ready", "False")],
    4: [("PIDPressure", "True"), ("NetworkUnavailable", "True"), ("Ready", "True")],
}
_NODE_TEXT = {
    ("DiskPressure", "True"): (4, "Node {} is running out of disk space"),
    ("MemoryPressure", "True"): (4, "Node {} is running out of available memory"),
    ("PIDPressure", "True"): (4, "Node {} is running out of process IDs"),
    ("NetworkUnavailable", "True"): (4, "Node {} network is not correctly configured"),
    ("Ready", "False"): (4, "Node {} has ''NodeReady'' condition ''false''"),
    ("Ready", "Unknown"): (2, "Node {} has ''NodeReady'' condition ''unknown''"),
}


def _node_case() -> tuple[str, str]:
    states, reasons = [], []
    for n, listed in _NODE_CONDITIONS.items():
        hits = [_NODE_TEXT[c] for c in listed if c in _NODE_TEXT]
        state = {4: "critical", 2: "unknown"}[hits[-1][0]] if hits else "ok"
        body = "'" + (". ".join(h[1] for h in hits) + "." if hits else "Node {} is ok.") + "'"
        states.append(f"WHEN {n} THEN '{state}'")
        reasons.append(f"WHEN {n} THEN replace({body}, '{{}}', 'node-' || {_C})")
    return f"CASE {_C} % 5 {' '.join(states)} END", f"CASE {_C} % 5 {' '.join(reasons)} END"


_INFO = {
    "machineID": "machine_id",
    "systemUUID": "system_uuid",
    "bootID": "boot_id",
    "kernelVersion": "kernel_version",
    "osImage": "os_image",
    "operatingSystem": "operating_system",
    "architecture": "architecture",
    "containerRuntimeVersion": "container_runtime_version",
    "kubeletVersion": "kubelet_version",
    "kubeProxyVersion": "kube_proxy_version",
}
_NODE_LABELS = [("node-role.kubernetes.io/worker", "''"), ("node-role.kubernetes.io/control-plane", "''"), ("zone", "c_mktsegment")]

register(
    "node",
    "customer",
    {
        "metadata": metadata(
            "node",
            _C,
            ", 'labels', map('node-role.kubernetes.io/worker', '', 'node-role.kubernetes.io/control-plane', '', 'zone', c_mktsegment)",
        ),
        "spec": f"named_struct('podCIDR', CASE WHEN {_C} % 4 = 0 THEN '' ELSE concat('10.0.0.0/', {_C} % 16 + 12) END, 'unschedulable', CASE WHEN {_C} % 2 = 0 THEN true END)",
        "status": f"""named_struct('capacity', map('cpu', CAST({_C} % 64 AS STRING), 'memory', concat({_C} % 100, 'Ki')),
          'allocatable', map('cpu', concat({_C} % 999, 'm'), 'memory', '1Gi', 'pods', CAST({_C} % 110 AS STRING)),
          'nodeInfo', named_struct({", ".join(f"'{n}', concat('{n}-', {_C})" for n in _INFO)}),
          'conditions', CASE CAST({_C} % 5 AS INT) {" ".join(f"WHEN {n} THEN array({', '.join(_NODE_CONDITION.format(*x) for x in listed)})" for n, listed in _NODE_CONDITIONS.items())} END,
          'volumesInUse', array('vol-a', concat('vol-', {_C} % 3)),
          'volumesAttached', array(named_struct('name', 'vol-1', 'devicePath', '/dev/1'), named_struct('name', 'vol-a', 'devicePath', '/dev/a')))""",
    },
    {
        "node": f"""SELECT {header_sql('node', _C)}, CASE WHEN {_C} % 4 = 0 THEN '' ELSE '10.0.0.0/' || ({_C} % 16 + 12) END AS pod_cidr,
          CASE WHEN {_C} % 4 = 0 THEN 0 ELSE (1::BIGINT << (32 - CAST({_C} % 16 + 12 AS INTEGER))) - 2 END AS num_ips, {_C} % 2 = 0 AS unschedulable, {_C} % 5 IN (0, 4) AS ready,
          {_C} % 64 * 1000 AS cpu_capacity, {_C} % 999 AS cpu_allocatable, {_C} % 100 * 1024000 AS memory_capacity, 1073741824000 AS memory_allocatable, {_C} % 110 AS pod_capacity,
          'control-plane, worker' AS roles, {", ".join(f"'{n}-' || {_C} AS {column}" for n, column in _INFO.items())}, {_node_case()[0]} AS health_state, {_node_case()[1]} AS health_reason FROM customer""",
        "node_condition": f"""SELECT {_NODE_UUID} AS node_uuid, type, status, 1704153600000 AS last_heartbeat, 1704240000000 AS last_transition, 'r' AS reason, '' AS message FROM customer JOIN (VALUES
          {", ".join(f"({n}, '{a}', '{b.lower()}')" for n, listed in _NODE_CONDITIONS.items() for a, b in listed)}) x(n, type, status) ON n = {_C} % 5""",
        "node_volume": f"""SELECT {_NODE_UUID} AS node_uuid, 'vol-1' AS name, '/dev/1' AS device_path, {_C} % 3 = 1 AS mounted FROM customer
          UNION ALL SELECT {_NODE_UUID}, 'vol-a', '/dev/a', TRUE FROM customer""",
        "node_label": _pair_sql("customer", _C, _NODE_UUID, _NODE_LABELS, "owner AS node_uuid, uuid AS label_uuid"),
    },
)


# --------------------------------------------------------------------------- controllers

_P = "p_partkey"
_STATE_CONDITION = "array(named_struct('type', p_type, 'status', CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END, 'lastUpdateTime', TIMESTAMP '2024-01-02 00:00:00', 'lastTransitionTime', TIMESTAMP '2024-01-03 00:00:00', 'message', p_name))"
_OWNER = ", 'ownerReferences', array(named_struct('uid', p_brand, 'kind', 'DaemonSet', 'name', p_name, 'blockOwnerDeletion', p_size > 20))"


def _condition_sql(kind: str, extra: str) -> str:
    return f"""SELECT {uid_sql(kind, _P)} AS {kind}_uuid, p_type AS type, CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END AS status, {extra}
      1704240000000 AS last_transition, '' AS reason, p_name AS message FROM part"""


def _owner_sql(kind: str) -> str:
    return f"""SELECT {uid_sql(kind, _P)} AS {kind}_uuid, {sql_uuid5(OBJECT_SPACE, 'p_brand')} AS owner_uuid, 'daemon_set' AS kind, p_name AS name, p_brand AS uid,
      FALSE AS controller, p_size > 20 AS block_owner_deletion FROM part"""


_WHO = "'ns-' || (p_partkey % 7) || '/{}-' || p_partkey"

register(
    "deployment",
    "part",
    {
        "metadata": metadata("deployment", _P, _OWNER),
        "spec": f"named_struct('replicas', p_size, 'strategy', named_struct('type', 'Recreate'), 'progressDeadlineSeconds', 600, 'paused', {_P} % 2 = 0)",
        "status": f"""named_struct('replicas', p_size, 'availableReplicas', CAST(greatest(p_size - {_P} % 3, 0) AS INT), 'readyReplicas', 1,
          'unavailableReplicas', CASE WHEN {_P} % 5 = 0 THEN 2 END, 'conditions', {_STATE_CONDITION})""",
    },
    {
        "deployment": f"""SELECT {header_sql('deployment', _P)}, 'Recreate' AS strategy, 0 AS min_ready_seconds, 600 AS progress_deadline_seconds, {_P} % 2 = 0 AS paused,
          p_size AS desired_replicas, p_size AS actual_replicas, 0 AS updated_replicas, 1 AS ready_replicas, have AS available_replicas,
          CASE WHEN {_P} % 5 = 0 THEN 2 ELSE 0 END AS unavailable_replicas,
          CASE WHEN {_P} % 5 = 0 THEN 'critical' WHEN have < p_size THEN 'warning' ELSE 'ok' END AS health_state,
          'Deployment ' || {_WHO.format('deployment')} || CASE WHEN {_P} % 5 = 0 THEN ' has 2 unavailable replicas.'
            WHEN have < p_size THEN printf(' only has %d out of %d desired replicas available.', have, p_size) ELSE printf(' has all %d desired replicas available.', p_size) END AS health_reason
          FROM (SELECT *, CAST(greatest(p_size - {_P} % 3, 0) AS INTEGER) AS have FROM part)""",
        "deployment_condition": _condition_sql("deployment", "1704153600000 AS last_update,"),
        "deployment_owner": _owner_sql("deployment"),
    },
)

register(
    "daemon_set",
    "part",
    {
        "metadata": metadata("daemon_set", _P, _OWNER),
        "spec": "named_struct('updateStrategy', named_struct('type', 'OnDelete'), 'minReadySeconds', 5)",
        "status": f"""named_struct('desiredNumberScheduled', CAST(p_size - 1 AS INT), 'numberAvailable', CAST(p_size % 4 * 5 AS INT), 'numberReady', 1, 'conditions', {_STATE_CONDITION})""",
    },
    {
        "daemon_set": f"""SELECT {header_sql('daemon_set', _P)}, 'OnDelete' AS update_strategy, 5 AS min_ready_seconds, want AS desired_number_scheduled, 0 AS current_number_scheduled,
          0 AS number_misscheduled, 1 AS number_ready, 0 AS update_number_scheduled, have AS number_available, 0 AS number_unavailable,
          CASE WHEN want < 1 THEN 'unknown' WHEN have = 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS health_state,
          'DaemonSet ' || {_WHO.format('daemon_set')} || CASE WHEN want < 1 THEN printf(' has an invalid desired node count: %d.', want)
            WHEN have = 0 THEN printf(' does not have a single pod available which should run on %d desired nodes.', want)
            WHEN have < want THEN printf(' pods are only available on %d out of %d desired nodes.', have, want)
            ELSE printf(' has pods available on all %d desired nodes.', want) END AS health_reason
          FROM (SELECT *, p_size - 1 AS want, p_size % 4 * 5 AS have FROM part)""",
        "daemon_set_condition": _condition_sql("daemon_set", ""),
        "daemon_set_owner": _owner_sql("daemon_set"),
    },
)

register(
    "replica_set",
    "part",
    {
        "metadata": metadata("replica_set", _P, _OWNER),
        "spec": "named_struct('replicas', CASE WHEN p_size > 5 THEN p_size END)",
        "status": f"named_struct('availableReplicas', CAST(p_size % 4 * 5 AS INT), 'fullyLabeledReplicas', 2, 'conditions', {_STATE_CONDITION})",
    },
    {
        "replica_set": f"""SELECT {header_sql('replica_set', _P)}, want AS desired_replicas, 0 AS min_ready_seconds, 0 AS actual_replicas, 2 AS fully_labeled_replicas, 0 AS ready_replicas,
          have AS available_replicas, CASE WHEN have < 1 AND want > 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS health_state,
          'ReplicaSet ' || {_WHO.format('replica_set')} || CASE WHEN have < 1 AND want > 0 THEN printf(' has no replica available from %d desired.', want)
            WHEN have < want THEN printf(' only has %d out of %d desired replicas available.', have, want) ELSE printf(' has all %d desired replicas available.', want) END AS health_reason
          FROM (SELECT *, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS want, p_size % 4 * 5 AS have FROM part)""",
        "replica_set_condition": _condition_sql("replica_set", ""),
        "replica_set_owner": _owner_sql("replica_set"),
    },
)

register(
    "stateful_set",
    "part",
    {
        "metadata": metadata("stateful_set", _P, _OWNER),
        "spec": f"""named_struct('replicas', CASE WHEN p_size > 5 THEN p_size END, 'ordinals', CASE WHEN {_P} % 2 = 0 THEN named_struct('start', 3) END, 'serviceName', p_name,
          'podManagementPolicy', 'Parallel', 'updateStrategy', named_struct('type', 'OnDelete'),
          'persistentVolumeClaimRetentionPolicy', CASE WHEN {_P} % 3 = 0 THEN named_struct('whenDeleted', 'Delete', 'whenScaled', 'Retain') END)""",
        "status": f"named_struct('availableReplicas', CAST(p_size % 4 * 5 AS INT), 'currentReplicas', 2, 'conditions', {_STATE_CONDITION})",
    },
    {
        "stateful_set": f"""SELECT {header_sql('stateful_set', _P)}, want AS desired_replicas, p_name AS service_name, 'Parallel' AS pod_management_policy, 'OnDelete' AS update_strategy,
          0 AS min_ready_seconds, CASE WHEN {_P} % 3 = 0 THEN 'Delete' ELSE 'Retain' END AS persistent_volume_claim_retention_policy_when_deleted,
          'Retain' AS persistent_volume_claim_retention_policy_when_scaled, CASE WHEN {_P} % 2 = 0 THEN 3 ELSE 0 END AS ordinals, 0 AS actual_replicas, 0 AS ready_replicas, 2 AS current_replicas,
          0 AS updated_replicas, have AS available_replicas, CASE WHEN have = 0 THEN 'critical' WHEN have < want THEN 'warning' ELSE 'ok' END AS health_state,
          'StatefulSet ' || {_WHO.format('stateful_set')} || CASE WHEN have = 0 THEN printf(' has no replica available from %d desired.', want)
            WHEN have < want THEN printf(' only has %d out of %d desired replicas available.', have, want) ELSE printf(' has all %d desired replicas available.', want) END AS health_reason
          FROM (SELECT *, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS want, p_size % 4 * 5 AS have FROM part)""",
        "stateful_set_condition": _condition_sql("stateful_set", ""),
        "stateful_set_owner": _owner_sql("stateful_set"),
    },
)


# --------------------------------------------------------------------------- jobs

_E = "event_id"
_JOB_CONDITIONS = {
    0: [("SuccessCriteriaMet", "True"), ("Failed", "True")],
    1: [("Complete", "False"), ("Complete", "True")],
    2: [("Other", "True"), ("Failed", "True")],
    3: [("FailureTarget", "True"), ("Failed", "True")],
    4: [("Suspended", "True")],
    5: [("Failed", "False")],
    6: [],
}
_JOB_CONDITION = "named_struct('type', '{}', 'status', '{}', 'reason', 'Why', 'message', event_type, 'lastProbeTime', ts, 'lastTransitionTime', ts)"
_JOB = "'Job ns-' || (event_id % 7) || '/job-' || event_id"
_JOB_DONE = "CASE WHEN event_id % 2 = 0 THEN concat(event_id % 5, ' {}pod completions') ELSE 'any pod completion' END"

register(
    "job",
    "events",
    {
        "metadata": metadata("job", _E),
        "spec": f"""named_struct('parallelism', CAST(2 AS INT), 'completions', CASE WHEN {_E} % 2 = 0 THEN CAST({_E} % 5 AS INT) END,
          'activeDeadlineSeconds', CASE WHEN {_E} % 3 = 0 THEN {_E} END, 'backoffLimit', CASE WHEN {_E} % 4 <> 0 THEN 6 END, 'completionMode', 'Indexed')""",
        "status": f"""named_struct('startTime', CASE WHEN {_E} % 5 <> 0 THEN date_trunc('second', ts) END, 'active', 1, 'failed', CAST({_E} % 3 AS INT),
          'conditions', CASE CAST({_E} % 7 AS INT) {" ".join(f"WHEN {n} THEN array({', '.join(_JOB_CONDITION.format(*x) for x in listed)})" for n, listed in _JOB_CONDITIONS.items() if listed)} END)""",
    },
    {
        "job": f"""SELECT {header_sql('job', _E)}, 2 AS parallelism, CASE WHEN {_E} % 2 = 0 THEN CAST({_E} % 5 AS INTEGER) END AS completions,
          CASE WHEN {_E} % 3 = 0 THEN {_E} END AS active_deadline_seconds, CASE WHEN {_E} % 4 <> 0 THEN 6 END AS backoff_limit, NULL::INTEGER AS ttl_seconds_after_finished,
          'Indexed' AS completion_mode, NULL::BOOLEAN AS suspend, CASE WHEN {_E} % 5 <> 0 THEN epoch_us(date_trunc('second', ts)) // 1000 END AS start_time, NULL::BIGINT AS completion_time,
          1 AS active, 0 AS succeeded, CAST({_E} % 3 AS INTEGER) AS failed,
          CASE {_E} % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'critical' WHEN 3 THEN 'warning' WHEN 4 THEN 'ok' ELSE 'pending' END AS health_state,
          {_JOB} || CASE {_E} % 7 WHEN 0 THEN ' met its sucess criteria.'
            WHEN 1 THEN ' has completed its execution successfully with ' || {_JOB_DONE.format('necessary ')} || '.'
            WHEN 2 THEN ' has failed its execution. Why: ' || event_type || '.' WHEN 3 THEN ' is about to fail its execution. Why: ' || event_type || '.' WHEN 4 THEN ' is suspended.'
            ELSE concat(' is running since ', CASE WHEN {_E} % 5 = 0 THEN '<nil>' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S +0000 UTC') END,
              ' with currently 1 active, 0 completed and ', {_E} % 3, ' failed pods. Successful termination requires ', {_JOB_DONE.format('')}, '. The back-off limit is ',
              CASE WHEN {_E} % 4 <> 0 THEN '6' ELSE '<nil>' END, '.', CASE WHEN {_E} % 3 = 0 THEN concat(' Deadline for completion is ', {_E}, '.') ELSE '' END) END AS health_reason FROM events""",
        "job_condition": f"""SELECT {uid_sql('job', _E)} AS job_uuid, type, status, epoch_us(ts) // 1000 AS last_probe, epoch_us(ts) // 1000 AS last_transition, 'Why' AS reason, event_type AS message
          FROM events JOIN (VALUES {", ".join(f"({n}, '{a}', '{b.lower()}')" for n, listed in _JOB_CONDITIONS.items() for a, b in listed)}) x(n, type, status) ON n = {_E} % 7""",
    },
)

register(
    "cron_job",
    "orders",
    {
        "metadata": metadata("cron_job", _K),
        "spec": f"""named_struct('schedule', '* * * * *', 'timeZone', CASE WHEN {_K} % 3 = 0 THEN '' WHEN {_K} % 3 = 1 THEN 'UTC' END, 'startingDeadlineSeconds', CASE WHEN {_K} % 4 = 0 THEN 86400 END,
          'concurrencyPolicy', 'Allow', 'suspend', {_K} % 5 = 0, 'successfulJobsHistoryLimit', 3, 'failedJobsHistoryLimit', 1)""",
        "status": f"""named_struct('active', CASE WHEN {_K} % 2 = 0 THEN array(named_struct('name', 'a'), named_struct('name', 'b')) END,
          'lastScheduleTime', CASE WHEN {_K} % 11 <> 0 THEN o_orderdate END, 'lastSuccessfulTime', CASE WHEN {_K} % 13 <> 0 THEN o_orderdate + CASE WHEN {_K} % 7 = 0 THEN INTERVAL '-1' DAY ELSE INTERVAL '1' DAY END END)""",
    },
    {
        "cron_job": f"""WITH x AS (SELECT *, 'CronJob cron_job-' || {_K} AS n, CASE WHEN {_K} % 11 <> 0 THEN o_orderdate END AS s,
            CASE WHEN {_K} % 13 <> 0 THEN o_orderdate + CASE WHEN {_K} % 7 = 0 THEN INTERVAL (-1) DAY ELSE INTERVAL 1 DAY END END AS p,
            {_K} % 4 = 0 AND TIMESTAMP '{NOW}' > o_orderdate + INTERVAL 1 DAY AS late FROM orders)
          SELECT {header_sql('cron_job', _K)}, '* * * * *' AS schedule, CASE WHEN {_K} % 3 = 0 THEN '' WHEN {_K} % 3 = 1 THEN 'UTC' END AS timezone,
          CASE WHEN {_K} % 4 = 0 THEN 86400::BIGINT END AS starting_deadline_seconds, 'Allow' AS concurrency_policy, {_K} % 5 = 0 AS suspend, 3 AS successful_jobs_history_limit, 1 AS failed_jobs_history_limit,
          CASE WHEN {_K} % 2 = 0 THEN 2 ELSE 0 END AS active, epoch_us(s) // 1000 AS last_schedule_time, epoch_us(p) // 1000 AS last_successful_time,
          CASE WHEN s IS NULL THEN 'warning' WHEN p IS NULL OR late THEN 'critical' WHEN s > p OR {_K} % 5 = 0 THEN 'warning' ELSE 'ok' END AS health_state,
          n || CASE WHEN s IS NULL THEN ' has never been scheduled.' WHEN p IS NULL THEN ' has never completed successfully.'
            WHEN late THEN concat(' missed its starting deadline. Last scheduled at ', strftime(s, '%Y-%m-%dT%H:%M:%SZ'), ', deadline was ', strftime(s + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ'), '.')
            WHEN s > p THEN concat(' has recent schedules without success. Last successful run: ', strftime(p, '%Y-%m-%dT%H:%M:%SZ'), ', last scheduled: ', strftime(s, '%Y-%m-%dT%H:%M:%SZ'), '.')
            WHEN {_K} % 5 = 0 THEN ' is currently suspended.' ELSE concat(' is operating normally. Last successful run: ', strftime(p, '%Y-%m-%dT%H:%M:%SZ'), '.') END AS health_reason FROM x""",
    },
)


# --------------------------------------------------------------------------- services and slices

_SERVICE_UUID = uid_sql("service", _P)
_SELECTOR = [("brand", "p_brand"), ("Type", "p_type")]

register(
    "service",
    "part",
    {
        "metadata": metadata("service", _P, ", 'labels', map('brand', p_brand, 'Type', p_type), 'annotations', map('brand', p_name)"),
        "spec": f"""named_struct('clusterIP', '10.0.0.1', 'clusterIPs', array('10.0.0.1', 'fd00::1'), 'type', 'NodePort', 'externalIPs', CASE WHEN {_P} % 2 = 0 THEN array('1.1.1.1', '2.2.2.2') END,
          'sessionAffinity', 'None', 'externalName', '', 'healthCheckNodePort', CAST({_P} % 3 AS INT), 'publishNotReadyAddresses', {_P} % 2 = 1,
          'ipFamilies', CASE CAST({_P} % 5 AS INT) WHEN 0 THEN array('IPv4') WHEN 1 THEN array('IPv6', 'IPv4') WHEN 2 THEN array('IPv6') WHEN 3 THEN array('Other') END,
          'ipFamilyPolicy', 'SingleStack', 'allocateLoadBalancerNodePorts', CASE WHEN {_P} % 4 = 0 THEN false END, 'loadBalancerClass', CASE WHEN {_P} % 4 = 1 THEN '' END,
          'internalTrafficPolicy', CASE WHEN {_P} % 4 = 2 THEN 'Local' END,
          'ports', array(named_struct('name', 'http', 'protocol', 'TCP', 'appProtocol', CAST(NULL AS STRING), 'port', 80, 'targetPort', 'web', 'nodePort', 30000 + p_size),
            named_struct('name', 'db', 'protocol', 'TCP', 'appProtocol', 'sql', 'port', 5432, 'targetPort', CAST(p_size AS STRING), 'nodePort', CAST(NULL AS INT))),
          'selector', map('brand', p_brand, 'Type', p_type))""",
        "status": "named_struct('conditions', array(named_struct('type', 'LoadBalancerPortsError', 'status', 'True', 'observedGeneration', 7, 'lastTransitionTime', TIMESTAMP '2024-01-03 00:00:00', 'reason', 'r', 'message', 'm')))",
    },
    {
        "service": f"""SELECT {header_sql('service', _P)}, '10.0.0.1' AS cluster_ip, '10.0.0.1, fd00::1' AS cluster_ips, 'NodePort' AS type, CASE WHEN {_P} % 2 = 0 THEN '1.1.1.1, 2.2.2.2' END AS external_ips,
          'None' AS session_affinity, NULL::VARCHAR AS external_name, NULL::VARCHAR AS external_traffic_policy, CAST(nullif({_P} % 3, 0) AS INTEGER) AS health_check_node_port, {_P} % 2 = 1 AS publish_not_ready_addresses,
          CASE {_P} % 5 WHEN 0 THEN 'IPv4' WHEN 1 THEN 'DualStack' WHEN 2 THEN 'IPv6' WHEN 3 THEN 'Unknown' END AS ip_families, 'SingleStack' AS ip_family_policy, {_P} % 4 <> 0 AS allocate_load_balancer_node_ports,
          CASE WHEN {_P} % 4 = 1 THEN '' END AS load_balancer_class, CASE WHEN {_P} % 4 = 2 THEN 'Local' ELSE 'Cluster' END AS internal_traffic_policy FROM part""",
        "service_port": f"""SELECT {_SERVICE_UUID} AS service_uuid, 'http' AS name, 'TCP' AS protocol, '' AS app_protocol, 80 AS port, 'web' AS target_port, 30000 + p_size AS node_port FROM part
          UNION ALL SELECT {_SERVICE_UUID}, 'db', 'TCP', 'sql', 5432, p_size::VARCHAR, 0 FROM part""",
        "service_condition": f"""SELECT {_SERVICE_UUID} AS service_uuid, 'LoadBalancerPortsError' AS type, 'true' AS status, 7::BIGINT AS observed_generation, 1704240000000 AS last_transition, 'r' AS reason, 'm' AS message FROM part""",
        "selector": _pair_sql("part", _P, _SERVICE_UUID, _SELECTOR, "uuid, name, value"),
        "service_selector": _pair_sql("part", _P, _SERVICE_UUID, _SELECTOR, "owner AS service_uuid, uuid AS selector_uuid"),
        "resource_label": _pair_sql("part", _P, _SERVICE_UUID, _SELECTOR, "owner AS resource_uuid, uuid AS label_uuid"),
        "service_annotation": _pair_sql("part", _P, _SERVICE_UUID, [("brand", "p_name")], "owner AS service_uuid, uuid AS annotation_uuid"),
    },
)

_SLICE_UUID = uid_sql("endpoint_slice", _P)

register(
    "endpoint_slice",
    "part",
    {
        "metadata": metadata("endpoint_slice", _P, ", 'labels', map('brand', p_brand)"),
        "addressType": "'IPv4'",
        "endpoints": f"""array(named_struct('hostname', p_name, 'nodeName', CAST(NULL AS STRING), 'addresses', array('10.0.0.1', '10.0.0.2'),
            'conditions', named_struct('ready', true, 'serving', CAST(NULL AS BOOLEAN)), 'targetRef', named_struct('kind', 'Pod', 'namespace', 'n', 'name', p_name, 'uid', CAST({_P} AS STRING))),
          named_struct('hostname', CAST(NULL AS STRING), 'nodeName', p_brand, 'addresses', array('10.0.0.3'), 'conditions', named_struct('ready', false, 'serving', true), 'targetRef', NULL))""",
        "ports": "array(named_struct('name', 'http', 'protocol', 'TCP', 'port', 80), named_struct('name', CAST(NULL AS STRING), 'protocol', 'UDP', 'port', p_size))",
    },
    {
        "endpoint_slice": f"SELECT {header_sql('endpoint_slice', _P)}, 'IPv4' AS address_type FROM part",
        "endpoint": f"""SELECT {sql_uuid5('s', 'port_name || address || port')} AS uuid, s AS endpoint_slice_uuid, host_name, node_name, ready, serving, NULL::BOOLEAN AS terminating, address, protocol, port, port_name, '' AS app_protocol
          FROM (SELECT {_SLICE_UUID} AS s, * FROM part), LATERAL (SELECT p_name AS host_name, '' AS node_name, TRUE AS ready, NULL::BOOLEAN AS serving, unnest(['10.0.0.1', '10.0.0.2']) AS address
            UNION ALL SELECT '', p_brand, FALSE, TRUE, '10.0.0.3') e, LATERAL (SELECT 'http' AS port_name, 'TCP' AS protocol, 80 AS port UNION ALL SELECT '', 'UDP', p_size) p""",
        "endpoint_target_ref": f"""SELECT {_SLICE_UUID} AS endpoint_slice_uuid, 'Pod' AS kind, 'n' AS namespace, p_name AS name, {_P}::VARCHAR AS uid, '' AS api_version, '' AS resource_version FROM part
          UNION ALL SELECT {_SLICE_UUID}, NULL, '', '', '', '', '' FROM part""",
        "endpoint_slice_label": _pair_sql("part", _P, _SLICE_UUID, [("brand", "p_brand")], "owner AS endpoint_slice_uuid, uuid AS label_uuid"),
    },
)


# --------------------------------------------------------------------------- ingresses

_INGRESS_UUID = uid_sql("ingress", _C)
_NO_SERVICE = "CAST(NULL AS STRUCT<name: STRING, port: STRUCT<name: STRING, number: INT>>)"
_NO_RESOURCE = "CAST(NULL AS STRUCT<apiGroup: STRING, kind: STRING, name: STRING>)"


def _backend(service: str | None = None, resource: str | None = None) -> str:
    return f"named_struct('service', {service or _NO_SERVICE}, 'resource', {resource or _NO_RESOURCE})"


_SHOP = "named_struct('name', c_mktsegment, 'port', named_struct('name', 'http', 'number', CAST(NULL AS INT)))"
_BUCKET = "named_struct('apiGroup', CASE WHEN c_custkey % 2 = 0 THEN 'k8s' END, 'kind', 'Bucket', 'name', c_mktsegment)"

_SERVICE_RULE = sql_uuid5("i", "'shop.com' || '/' || c_mktsegment")
_RESOURCE_RULE = sql_uuid5("i", "'/static' || c_mktsegment")
_INGRESSES = f"(SELECT *, {_INGRESS_UUID} AS i FROM customer)"
_RULED = f"(SELECT *, {_SERVICE_RULE} AS r1, {_RESOURCE_RULE} AS r2 FROM {_INGRESSES})"

register(
    "ingress",
    "customer",
    {
        "metadata": metadata("ingress", _C),
        "spec": f"""named_struct('tls', array(named_struct('hosts', array('a.com', c_name), 'secretName', 's'), named_struct('hosts', array('b.com'), 'secretName', CAST(NULL AS STRING))),
          'defaultBackend', CASE WHEN {_C} % 3 = 0 THEN {_backend(_SHOP)} WHEN {_C} % 3 = 1 THEN {_backend(None, _BUCKET)} END,
          'rules', array(named_struct('host', 'shop.com', 'http', named_struct('paths', array(named_struct('path', '/', 'pathType', 'Prefix', 'backend', {_backend(_SHOP)})))),
            named_struct('host', CAST(NULL AS STRING), 'http', named_struct('paths', array(named_struct('path', '/static', 'pathType', 'Exact', 'backend', {_backend(None, _BUCKET)}))))))""",
    },
    {
        "ingress": f"SELECT {header_sql('ingress', _C)} FROM customer",
        "ingress_tls": f"SELECT i AS ingress_uuid, h AS tls_host, s AS tls_secret FROM {_INGRESSES}, LATERAL (SELECT unnest(['a.com', c_name]) AS h, 's' AS s UNION ALL SELECT 'b.com', '') x",
        "ingress_rule": f"""SELECT r1 AS uuid, {sql_uuid5('r1', 'c_mktsegment')} AS backend_uuid, i AS ingress_uuid, 'shop.com' AS host, '/' AS path, 'Prefix' AS path_type FROM {_RULED}
          UNION ALL SELECT r2, {sql_uuid5('r2', 'c_mktsegment')}, i, NULL, '/static', 'Exact' FROM {_RULED}""",
        "ingress_backend_service": f"""SELECT {sql_uuid5('r1', 'c_mktsegment')} AS service_uuid, i AS ingress_uuid, r1 AS ingress_rule_uuid, c_mktsegment AS service_name, 'http' AS service_port_name, 0 AS service_port_number FROM {_RULED}
          UNION ALL SELECT {sql_uuid5('i', "c_mktsegment || 'http'")}, i, NULL, c_mktsegment, 'http', 0 FROM {_RULED} WHERE {_C} % 3 = 0""",
        "ingress_backend_resource": f"""SELECT {sql_uuid5('r2', 'c_mktsegment')} AS resource_uuid, i AS ingress_uuid, r2 AS ingress_rule_uuid, CASE WHEN {_C} % 2 = 0 THEN 'k8s' END AS api_group, 'Bucket' AS kind, c_mktsegment AS name FROM {_RULED}
          UNION ALL SELECT {sql_uuid5('i', "'Bucket' || c_mktsegment")}, i, NULL, 'k8s', 'Bucket', c_mktsegment FROM {_RULED} WHERE {_C} % 3 = 1 AND {_C} % 2 = 0""",
    },
)


# --------------------------------------------------------------------------- storage and simple kinds

_PV_UUID = uid_sql("persistent_volume", _P)

register(
    "pvc",
    "part",
    {
        "metadata": metadata("pvc", _P, ", 'annotations', map('brand', p_brand)"),
        "spec": f"""named_struct('accessModes', CASE WHEN {_P} % 2 = 0 THEN array('ReadWriteOnce', 'ReadWriteMany') END, 'resources', named_struct('requests', map('storage', concat(p_size, 'Gi'))),
          'volumeName', '', 'volumeMode', CASE WHEN {_P} % 3 = 0 THEN 'Block' END, 'storageClassName', CASE WHEN {_P} % 3 = 1 THEN '' END)""",
        "status": f"""named_struct('phase', 'Bound', 'accessModes', array('ReadOnlyMany', 'ReadOnlyMany'), 'capacity', CASE WHEN {_P} % 2 = 1 THEN map('storage', concat(p_size, 'G')) END,
          'conditions', array(named_struct('type', 'FileSystemResizePending', 'status', 'True', 'lastProbeTime', TIMESTAMP '2024-01-02 00:00:00', 'lastTransitionTime', TIMESTAMP '2024-01-03 00:00:00')))""",
    },
    {
        "pvc": f"""SELECT {header_sql('pvc', _P)}, CASE WHEN {_P} % 2 = 0 THEN 5::SMALLINT END AS desired_access_modes, 2::SMALLINT AS actual_access_modes, p_size * 1073741824000 AS minimum_capacity,
          CASE WHEN {_P} % 2 = 1 THEN p_size * 1000000000000 END AS actual_capacity, 'Bound' AS phase, NULL::VARCHAR AS volume_name, CASE WHEN {_P} % 3 = 0 THEN 'Block' ELSE 'Filesystem' END AS volume_mode,
          CASE WHEN {_P} % 3 = 1 THEN '' END AS storage_class FROM part""",
        "pvc_condition": f"""SELECT {uid_sql('pvc', _P)} AS pvc_uuid, 'file_system_resize_pending' AS type, 'true' AS status, 1704153600000 AS last_probe, 1704240000000 AS last_transition, '' AS reason, '' AS message FROM part""",
        "resource_annotation": _pair_sql("part", _P, uid_sql("pvc", _P), [("brand", "p_brand")], "owner AS resource_uuid, uuid AS annotation_uuid"),
    },
)

register(
    "persistent_volume",
    "part",
    {
        "metadata": metadata("persistent_volume", _P, ", 'annotations', map('brand', p_brand)"),
        "spec": f"""named_struct('capacity', map('storage', concat(p_size, 'Gi')), 'accessModes', array('ReadWriteOncePod'), 'persistentVolumeReclaimPolicy', 'Retain', 'storageClassName', p_type,
          'claimRef', CASE WHEN {_P} % 2 = 0 THEN named_struct('kind', 'PersistentVolumeClaim', 'name', p_name, 'uid', p_brand) END, 'mountOptions', array('ro'),
          'hostPath', CASE WHEN {_P} % 3 = 0 THEN named_struct('path', p_name) END, 'csi', CASE WHEN {_P} % 3 = 1 THEN named_struct('driver', 'd') END)""",
        "status": "named_struct('phase', 'Bound', 'reason', '', 'message', p_name)",
    },
    {
        "persistent_volume": f"""SELECT {header_sql('persistent_volume', _P)}, 8::SMALLINT AS access_modes, p_size * 1073741824000 AS capacity, 'Retain' AS reclaim_policy, p_type AS storage_class, 'Filesystem' AS volume_mode,
          CASE {_P} % 3 WHEN 0 THEN 'HostPath' WHEN 1 THEN 'CSI' ELSE '' END AS volume_source_type,
          CASE {_P} % 3 WHEN 0 THEN '{{"path":"' || p_name || '"}}' WHEN 1 THEN '{{"driver":"d"}}' ELSE '' END AS volume_source, 'Bound' AS phase, NULL::VARCHAR AS reason, p_name AS message FROM part""",
        "persistent_volume_claim_ref": f"SELECT {_PV_UUID} AS persistent_volume_uuid, 'PersistentVolumeClaim' AS kind, p_name AS name, p_brand AS uid FROM part WHERE {_P} % 2 = 0",
        "resource_annotation": _pair_sql("part", _P, _PV_UUID, [("brand", "p_brand")], "owner AS resource_uuid, uuid AS annotation_uuid"),
    },
)

register(
    "namespace",
    "customer",
    {
        "metadata": metadata("namespace", _C),
        "status": "named_struct('phase', 'Active', 'conditions', array(named_struct('type', 'T', 'status', 'Unknown', 'lastTransitionTime', TIMESTAMP '2024-01-03 00:00:00', 'message', c_name)))",
    },
    {
        "namespace": f"SELECT {header_sql('namespace', _C)}, 'Active' AS phase FROM customer",
        "namespace_condition": f"SELECT {uid_sql('namespace', _C)} AS namespace_uuid, 'T' AS type, 'unknown' AS status, 1704240000000 AS last_transition, '' AS reason, c_name AS message FROM customer",
    },
)

register(
    "config_map",
    "part",
    {"metadata": metadata("config_map", _P), "immutable": f"CASE WHEN {_P} % 3 = 0 THEN true WHEN {_P} % 3 = 1 THEN false END", "data": "map('secret', p_name)"},
    {"config_map": f"SELECT {header_sql('config_map', _P)}, {_P} % 3 = 0 AS immutable FROM part"},
)

register(
    "secret",
    "part",
    {"metadata": metadata("secret", _P), "type": "p_type", "immutable": f"CASE WHEN {_P} % 3 = 0 THEN true END", "data": "map('secret', p_name)"},
    {"secret": f"SELECT {header_sql('secret', _P)}, p_type AS type, {_P} % 3 = 0 AS immutable FROM part"},
)

_MS = "epoch_us(date_trunc('second', ts)) // 1000"

register(
    "event",
    "events",
    {
        "metadata": metadata("event", _E),
        "regarding": "named_struct('uid', concat('user-', user_id), 'kind', 'Pod', 'namespace', '', 'name', concat('u', user_id))",
        "reportingController": "''",
        "reportingInstance": "'kubelet'",
        "reason": "event_type",
        "note": "props",
        "type": "'Normal'",
        "eventTime": f"CASE WHEN {_E} % 3 = 0 THEN date_trunc('second', ts) END",
        "deprecatedFirstTimestamp": f"CASE WHEN {_E} % 2 = 0 THEN date_trunc('second', ts) - INTERVAL '1' HOUR END",
        "deprecatedLastTimestamp": f"CASE WHEN {_E} % 5 = 0 THEN date_trunc('second', ts) + INTERVAL '1' HOUR END",
        "deprecatedCount": f"CAST({_E} % 4 AS INT)",
        "series": f"CASE WHEN {_E} % 7 = 0 THEN named_struct('count', CAST({_E} % 9 AS INT), 'lastObservedTime', CASE WHEN {_E} % 14 = 0 THEN date_trunc('second', ts) + INTERVAL '2' HOUR END) END",
    },
    {
        "event": f"""WITH x AS (SELECT *, CASE WHEN {_E} % 3 = 0 THEN {_MS} WHEN {_E} % 2 = 0 THEN {_MS} - 3600000 ELSE 1704067200000 END AS first FROM events)
          SELECT {header_sql('event', _E)}, {sql_uuid5(OBJECT_SPACE, "'user-' || user_id")} AS reference_uuid, NULL::VARCHAR AS reporting_controller, 'kubelet' AS reporting_instance, NULL::VARCHAR AS action,
          event_type AS reason, props AS note, 'Normal' AS type, 'Pod' AS reference_kind, NULL::VARCHAR AS reference_namespace, 'u' || user_id AS reference_name, first AS first_seen,
          CASE WHEN {_E} % 14 = 0 THEN {_MS} + 7200000 WHEN {_E} % 5 = 0 THEN {_MS} + 3600000 ELSE first END AS last_seen,
          CAST(greatest(CASE WHEN {_E} % 7 = 0 THEN {_E} % 9 END, {_E} % 4, 1) AS INTEGER) AS count FROM x""",
    },
)


@query("cluster_row", f"SELECT {uid_sql('nation', 'n_nationkey')} AS uuid, 'demo' AS name FROM nation WHERE n_nationkey = 0")
def cluster_row_query(t):
    named = t.nation.selectExpr(
        "named_struct('uid', concat('nation-', n_nationkey), 'name', CASE WHEN n_nationkey = 0 THEN 'kube-system' ELSE n_name END) AS metadata"
    )
    return cluster_row(named, "demo")

"""Input schemas (Spark DDL) and the relational tables they turn into."""

from __future__ import annotations

METADATA = """STRUCT<
  uid: STRING, name: STRING, namespace: STRING, resourceVersion: STRING,
  creationTimestamp: TIMESTAMP, deletionTimestamp: TIMESTAMP, deletionGracePeriodSeconds: BIGINT,
  labels: MAP<STRING, STRING>, annotations: MAP<STRING, STRING>,
  ownerReferences: ARRAY<STRUCT<uid: STRING, kind: STRING, name: STRING, controller: BOOLEAN, blockOwnerDeletion: BOOLEAN>>>"""

CONDITIONS = """ARRAY<STRUCT<
  type: STRING, status: STRING, reason: STRING, message: STRING, lastProbeTime: TIMESTAMP,
  lastHeartbeatTime: TIMESTAMP, lastUpdateTime: TIMESTAMP, lastTransitionTime: TIMESTAMP, observedGeneration: BIGINT>>"""

_TERMINATED = "STRUCT<exitCode: INT, signal: INT, reason: STRING, message: STRING, startedAt: TIMESTAMP, finishedAt: TIMESTAMP, containerID: STRING>"

# Probes are read as text: only their presence matters.
CONTAINER_SPECS = """ARRAY<STRUCT<
  name: STRING, image: STRING, imagePullPolicy: STRING, restartPolicy: STRING, readinessProbe: STRING, startupProbe: STRING,
  resources: STRUCT<limits: MAP<STRING, STRING>, requests: MAP<STRING, STRING>>,
  volumeMounts: ARRAY<STRUCT<name: STRING, mountPath: STRING, subPath: STRING, readOnly: BOOLEAN>>,
  volumeDevices: ARRAY<STRUCT<name: STRING, devicePath: STRING>>>>"""

CONTAINER_STATUSES = f"""ARRAY<STRUCT<
  name: STRING, ready: BOOLEAN, started: BOOLEAN, restartCount: INT,
  state: STRUCT<waiting: STRUCT<reason: STRING, message: STRING>, running: STRUCT<startedAt: TIMESTAMP>, terminated: {_TERMINATED}>,
  lastState: STRUCT<terminated: {_TERMINATED}>>>"""

_BACKEND = "STRUCT<service: STRUCT<name: STRING, port: STRUCT<name: STRING, number: INT>>, resource: STRUCT<apiGroup: STRING, kind: STRING, name: STRING>>"
_QUANTITIES = "MAP<STRING, STRING>"

# Kind -> fields next to ``metadata``.  Unions whose members are open-ended (volume
# sources) are read as raw JSON text and taken apart by the projection.
FIELDS = {
    "pod": f"""spec STRUCT<nodeName: STRING, restartPolicy: STRING, containers: {CONTAINER_SPECS},
        initContainers: {CONTAINER_SPECS}, volumes: ARRAY<STRING>>,
      status STRUCT<phase: STRING, reason: STRING, message: STRING, podIP: STRING, nominatedNodeName: STRING, qosClass: STRING,
        conditions: {CONDITIONS}, containerStatuses: {CONTAINER_STATUSES}, initContainerStatuses: {CONTAINER_STATUSES}>""",
    "node": f"""spec STRUCT<podCIDR: STRING, unschedulable: BOOLEAN>,
      status STRUCT<capacity: {_QUANTITIES}, allocatable: {_QUANTITIES},
        nodeInfo: STRUCT<machineID: STRING, systemUUID: STRING, bootID: STRING, kernelVersion: STRING, osImage: STRING,
          operatingSystem: STRING, architecture: STRING, containerRuntimeVersion: STRING, kubeletVersion: STRING, kubeProxyVersion: STRING>,
        conditions: {CONDITIONS}, addresses: ARRAY<STRUCT<type: STRING, address: STRING>>,
        volumesInUse: ARRAY<STRING>, volumesAttached: ARRAY<STRUCT<name: STRING, devicePath: STRING>>>""",
    "deployment": f"""spec STRUCT<replicas: INT, strategy: STRUCT<type: STRING>, minReadySeconds: INT, progressDeadlineSeconds: INT, paused: BOOLEAN>,
      status STRUCT<replicas: INT, updatedReplicas: INT, readyReplicas: INT, availableReplicas: INT, unavailableReplicas: INT, conditions: {CONDITIONS}>""",
    "daemon_set": f"""spec STRUCT<updateStrategy: STRUCT<type: STRING>, minReadySeconds: INT>,
      status STRUCT<desiredNumberScheduled: INT, currentNumberScheduled: INT, numberMisscheduled: INT, numberReady: INT,
        updatedNumberScheduled: INT, numberAvailable: INT, numberUnavailable: INT, conditions: {CONDITIONS}>""",
    "replica_set": f"""spec STRUCT<replicas: INT, minReadySeconds: INT>,
      status STRUCT<replicas: INT, fullyLabeledReplicas: INT, readyReplicas: INT, availableReplicas: INT, conditions: {CONDITIONS}>""",
    "stateful_set": f"""spec STRUCT<replicas: INT, ordinals: STRUCT<start: INT>, serviceName: STRING, podManagementPolicy: STRING,
        updateStrategy: STRUCT<type: STRING>, minReadySeconds: INT,
        persistentVolumeClaimRetentionPolicy: STRUCT<whenDeleted: STRING, whenScaled: STRING>>,
      status STRUCT<replicas: INT, readyReplicas: INT, currentReplicas: INT, updatedReplicas: INT, availableReplicas: INT, conditions: {CONDITIONS}>""",
    "job": f"""spec STRUCT<parallelism: INT, completions: INT, activeDeadlineSeconds: BIGINT, backoffLimit: INT,
        ttlSecondsAfterFinished: INT, suspend: BOOLEAN, completionMode: STRING>,
      status STRUCT<startTime: TIMESTAMP, completionTime: TIMESTAMP, active: INT, succeeded: INT, failed: INT, conditions: {CONDITIONS}>""",
    "cron_job": """spec STRUCT<schedule: STRING, timeZone: STRING, startingDeadlineSeconds: BIGINT, concurrencyPolicy: STRING,
        suspend: BOOLEAN, successfulJobsHistoryLimit: INT, failedJobsHistoryLimit: INT>,
      status STRUCT<active: ARRAY<STRING>, lastScheduleTime: TIMESTAMP, lastSuccessfulTime: TIMESTAMP>""",
    "service": f"""spec STRUCT<clusterIP: STRING, clusterIPs: ARRAY<STRING>, type: STRING, externalIPs: ARRAY<STRING>, sessionAffinity: STRING,
        externalName: STRING, externalTrafficPolicy: STRING, healthCheckNodePort: INT, publishNotReadyAddresses: BOOLEAN,
        ipFamilies: ARRAY<STRING>, ipFamilyPolicy: STRING, allocateLoadBalancerNodePorts: BOOLEAN, loadBalancerClass: STRING,
        internalTrafficPolicy: STRING,
        ports: ARRAY<STRUCT<name: STRING, protocol: STRING, appProtocol: STRING, port: INT, targetPort: STRING, nodePort: INT>>,
        selector: MAP<STRING, STRING>>,
      status STRUCT<conditions: {CONDITIONS}>""",
    "endpoint_slice": """addressType STRING,
      endpoints ARRAY<STRUCT<hostname: STRING, nodeName: STRING, addresses: ARRAY<STRING>,
        conditions: STRUCT<ready: BOOLEAN, serving: BOOLEAN, terminating: BOOLEAN>,
        targetRef: STRUCT<kind: STRING, namespace: STRING, name: STRING, uid: STRING, apiVersion: STRING, resourceVersion: STRING>>>,
      ports ARRAY<STRUCT<name: STRING, protocol: STRING, port: INT, appProtocol: STRING>>""",
    "ingress": f"""spec STRUCT<tls: ARRAY<STRUCT<hosts: ARRAY<STRING>, secretName: STRING>>, defaultBackend: {_BACKEND},
        rules: ARRAY<STRUCT<host: STRING, http: STRUCT<paths: ARRAY<STRUCT<path: STRING, pathType: STRING, backend: {_BACKEND}>>>>>>""",
    "pvc": f"""spec STRUCT<accessModes: ARRAY<STRING>, resources: STRUCT<requests: {_QUANTITIES}>, volumeName: STRING, volumeMode: STRING, storageClassName: STRING>,
      status STRUCT<phase: STRING, accessModes: ARRAY<STRING>, capacity: {_QUANTITIES}, conditions: {CONDITIONS}>""",
    "persistent_volume": """spec STRING,
      status STRUCT<phase: STRING, reason: STRING, message: STRING>""",
    "namespace": f"status STRUCT<phase: STRING, conditions: {CONDITIONS}>",
    "config_map": "immutable BOOLEAN",
    "secret": "type STRING, immutable BOOLEAN",
    "event": """regarding STRUCT<uid: STRING, kind: STRING, namespace: STRING, name: STRING>, reportingController STRING,
      reportingInstance STRING, action STRING, reason STRING, note STRING, type STRING, eventTime TIMESTAMP,
      deprecatedFirstTimestamp TIMESTAMP, deprecatedLastTimestamp TIMESTAMP, deprecatedCount INT,
      series STRUCT<count: INT, lastObservedTime: TIMESTAMP>""",
}

# The known part of a persistent volume's spec; its remaining field is the volume source.
PERSISTENT_VOLUME_SPEC = f"""accessModes ARRAY<STRING>, capacity {_QUANTITIES}, persistentVolumeReclaimPolicy STRING,
  storageClassName STRING, volumeMode STRING, claimRef STRUCT<kind: STRING, name: STRING, uid: STRING>"""
PERSISTENT_VOLUME_OTHER = (
    "accessModes",
    "capacity",
    "persistentVolumeReclaimPolicy",
    "storageClassName",
    "volumeMode",
    "claimRef",
    "mountOptions",
    "nodeAffinity",
    "volumeAttributesClassName",
)


def object_schema(kind: str) -> str:
    """Schema of one object of a kind."""
    return f"metadata {METADATA}, {FIELDS[kind]}"


CHANGE = "op STRING, seq BIGINT, kind STRING, uid STRING, key STRING, object STRING, cluster_uuid STRING"
SAMPLE = "metric STRING, labels MAP<STRING, STRING>, ts TIMESTAMP, value DOUBLE"
RULE = "id STRING, filter STRING"
RULE_FILTER = "version INT, kind STRING, query STRING, args ARRAY<STRING>"
INCIDENT = "object_tags STRUCT<uuid: STRING, cluster_uuid: STRING, resource: STRING, name: STRING, namespace: STRING>"
SETTING = "cluster_uuid STRING, key STRING, value STRING, locked BOOLEAN"
LOG_CHUNK = "container_uuid STRING, pod_uuid STRING, seq BIGINT, text STRING, ts TIMESTAMP"

# The settings a cluster may have.
SETTING_KEYS = (
    "notifications.url",
    "notifications.username",
    "notifications.password",
    "notifications.kubernetes_web_url",
    "prometheus.url",
    "prometheus.insecure",
    "prometheus.username",
    "prometheus.password",
)

"""Pods and their containers.

The containers of a pod are classified and rolled up inside the pod's row, so a pod is
normalised without a shuffle; the container tables are exploded from the same array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.ids import uuid5
from clusterlens.functions.quantity import milli_or_null
from clusterlens.functions.state import state_name
from clusterlens.functions.text import nullable, text
from clusterlens.operators.health import container_fold, container_verdict, pod_verdict
from clusterlens.operators.rollup import RESOURCES, pod_resources_in_row
from clusterlens.plans.common import (
    Build,
    Kind,
    Relation,
    conditions,
    document,
    exploded,
    flag,
    header,
    health_columns,
    owners,
    tagging,
    union_member,
    zero,
)

_RESOURCE_FIELDS = dict(zip(RESOURCES, (("limits", "cpu"), ("requests", "cpu"), ("limits", "memory"), ("requests", "memory"))))


def _specs() -> tuple[Column, Column, Column]:
    """The specs of a pod's containers: init, sidecar, app, each in spec order."""
    inits, apps = F.col("spec.initContainers"), F.col("spec.containers")
    inits, apps = F.coalesce(inits, F.filter(apps, lambda c: F.lit(False))), F.coalesce(apps, F.filter(inits, lambda c: F.lit(False)))

    def restarts(c: Column) -> Column:
        return F.coalesce(c["restartPolicy"] == "Always", F.lit(False))

    return F.filter(inits, lambda c: ~restarts(c)), F.filter(inits, restarts), apps


def _paired(role: str, specs: Column, statuses: Column) -> Column:
    """Containers with the status of their name (the last one, NULL if there is none)."""

    def pair(spec: Column) -> Column:
        status = F.try_element_at(F.filter(statuses, lambda s: s["name"] == spec["name"]), F.lit(-1))
        return F.struct(F.lit(role).alias("role"), spec.alias("spec"), status.alias("status"))

    return F.transform(specs, pair)


def _classified(c: Column) -> Column:
    return F.struct(
        c["role"].alias("role"),
        c["spec"].alias("spec"),
        c["status"].alias("status"),
        container_verdict(c["spec"], c["status"]).alias("health"),
        *[milli_or_null(c["spec"]["resources"][kind][what]).alias(name) for name, (kind, what) in _RESOURCE_FIELDS.items()],
    )


def prepare(objects: DataFrame, now: Column) -> DataFrame:
    """Add ``all_containers`` (init, sidecar, app, each in spec order) and their roll-up.

    Each ``transform`` fixes one intermediate result per element (status, then verdict), which
    the next one reads as a field: expressions inside a lambda are not shared otherwise.
    """
    inits, sidecars, apps = _specs()
    init_status, app_status = F.col("status.initContainerStatuses"), F.col("status.containerStatuses")
    paired = F.concat(
        _paired("init", inits, init_status),
        _paired("sidecar", sidecars, init_status),
        _paired("app", apps, app_status),
    )
    classified = objects.withColumn("all_containers", F.transform(paired, _classified))
    return classified.withColumn("fold", container_fold(F.col("all_containers")))


def project(pods: DataFrame, now: Column) -> DataFrame:
    verdict = pod_verdict(F.col("metadata"), F.col("status"), F.col("fold"), now)
    return pods.withColumn("_verdict", verdict).select(
        *header(),
        nullable(F.col("spec.nodeName")).alias("node_name"),
        nullable(F.col("status.nominatedNodeName")).alias("nominated_node_name"),
        nullable(F.col("status.podIP")).alias("ip"),
        text(F.col("status.phase")).alias("phase"),
        *health_columns(F.col("_verdict")),
        *[pod_resources_in_row(F.col("all_containers"), r).alias(r) for r in RESOURCES],
        nullable(F.col("status.reason")).alias("reason"),
        nullable(F.col("status.message")).alias("message"),
        nullable(F.col("status.qosClass")).alias("qos"),
        text(F.col("spec.restartPolicy")).alias("restart_policy"),
        document(pods),
    )


def containers(pods: DataFrame) -> DataFrame:
    """Every container of every pod, with its role."""
    found = exploded(pods, "all_containers", F.col("uuid").alias("pod_uuid"), names=("c",))
    spec, status, state = F.col("c.spec"), F.col("c.status"), F.col("c.status.state")

    def by_state(*outcomes: Column) -> Column:
        members = ("waiting", "running", "terminated")
        return F.coalesce(*[F.when(state[m].isNotNull(), o) for m, o in zip(members, outcomes)])

    return found.select(
        uuid5(F.col("pod_uuid"), spec["name"]).alias("uuid"),
        "pod_uuid",
        F.col("c.role").alias("role"),
        spec["name"].alias("name"),
        spec["image"].alias("image"),
        spec["imagePullPolicy"].alias("image_pull_policy"),
        *[F.col(f"c.{name}").alias(name) for name in RESOURCES],
        by_state(F.lit("Waiting"), F.lit("Running"), F.lit("Terminated")).alias("state"),
        by_state(F.to_json(state["waiting"]), F.to_json(state["running"]), F.to_json(state["terminated"])).alias(
            "state_details"
        ),
        flag(status["ready"]).alias("ready"),
        flag(status["started"]).alias("started"),
        zero(status["restartCount"]).alias("restart_count"),
        F.col("c.health.rank").alias("rank"),
        F.col("c.health.reason").alias("reason"),
    )


def _of_role(role: str) -> Build:
    restartable = [] if role == "init" else ["ready", "started", "restart_count"]

    def build(pods: DataFrame) -> DataFrame:
        return (
            containers(pods)
            .where(F.col("role") == role)
            .select(
                "uuid",
                "pod_uuid",
                "name",
                "image",
                "image_pull_policy",
                "state",
                "state_details",
                state_name(F.col("rank")).alias("health_state"),
                F.col("reason").alias("health_reason"),
                *RESOURCES,
                *restartable,
            )
        )

    return build


def _listed(pods: DataFrame, field: str) -> DataFrame:
    """``container_uuid, pod_uuid, item`` of a list in the specs of all containers, which needs no verdict about them."""
    specs = F.transform(F.concat(*_specs()), lambda c: F.struct(c["name"].alias("name"), c[field].alias("items")))
    found = exploded(pods, specs, F.col("uuid").alias("pod_uuid"), names=("c",))
    items = exploded(found, "c.items", "pod_uuid", F.col("c.name").alias("_name"))
    return items.select(uuid5(F.col("pod_uuid"), F.col("_name")).alias("container_uuid"), "pod_uuid", "item")


def devices(pods: DataFrame) -> DataFrame:
    return _listed(pods, "volumeDevices").select(
        "container_uuid", "pod_uuid", F.col("item.name").alias("name"), F.col("item.devicePath").alias("path")
    )


def mounts(pods: DataFrame) -> DataFrame:
    return _listed(pods, "volumeMounts").select(
        "container_uuid",
        "pod_uuid",
        F.col("item.name").alias("volume_name"),
        F.col("item.mountPath").alias("path"),
        nullable(F.col("item.subPath")).alias("sub_path"),
        flag(F.col("item.readOnly")).alias("read_only"),
    )


def _volumes(pods: DataFrame) -> DataFrame:
    return exploded(pods, "spec.volumes", F.col("uuid").alias("pod_uuid"), names=("v",)).select(
        "pod_uuid",
        F.get_json_object("v", "$.name").alias("volume_name"),
        F.get_json_object("v", "$.persistentVolumeClaim").alias("claim"),
        "v",
    )


def claims(pods: DataFrame) -> DataFrame:
    return (
        _volumes(pods)
        .where(F.col("claim").isNotNull())
        .select(
            "pod_uuid",
            "volume_name",
            F.get_json_object("claim", "$.claimName").alias("claim_name"),
            flag(F.get_json_object("claim", "$.readOnly").try_cast("boolean")).alias("read_only"),
        )
    )


def volumes(pods: DataFrame) -> DataFrame:
    member = union_member(F.col("v"), ["name"])
    return (
        _volumes(pods)
        .where(F.col("claim").isNull())
        .withColumn("m", member)
        .select("pod_uuid", "volume_name", F.col("m.type").alias("type"), F.col("m.source").alias("source"))
    )


def _container_children(build: bool) -> tuple[Relation, ...]:
    key = "container_uuid"
    return (
        Relation("container_device", key, (key, "name"), devices if build else None),
        # Wider than one row per volume: a container may mount a volume at several paths.
        Relation("container_mount", key, (key, "volume_name", "path"), mounts if build else None),
        Relation("container_log", key, (key,)),
    )


def kind() -> Kind:
    fk = "pod_uuid"
    return Kind(
        "pod",
        project,
        (
            conditions("pod"),
            # The explosion of devices and mounts covers all roles, so it hangs on one of them.
            Relation("container", fk, ("uuid",), _of_role("app"), children=_container_children(True)),
            Relation("init_container", fk, ("uuid",), _of_role("init"), children=_container_children(False)),
            Relation("sidecar_container", fk, ("uuid",), _of_role("sidecar"), children=_container_children(False)),
            owners("pod"),
            *tagging("pod"),
            Relation("pod_pvc", fk, (fk, "volume_name", "claim_name"), claims),
            Relation("pod_volume", fk, (fk, "volume_name"), volumes),
            Relation("service_pod", fk, ("service_uuid", fk)),
        ),
        prepare,
        notifies=True,
    )

"""Nodes, workload controllers and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.quantity import milli, usable_addresses, whole
from clusterlens.functions.text import text
from clusterlens.operators import health
from clusterlens.plans.common import (
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
    zero,
)


def _c(path: str) -> Column:
    return F.col(path)


# --------------------------------------------------------------------------- node


def node_roles(labels: Column) -> Column:
    """Role names from the label names, sorted."""
    names = F.filter(F.map_keys(labels), lambda k: F.contains(k, F.lit("node-role")))
    roles = F.transform(names, lambda k: F.split_part(k, F.lit("/"), F.lit(2)))
    return F.coalesce(F.array_join(F.sort_array(roles), ", "), F.lit(""))


def node(nodes: DataFrame, now: Column) -> DataFrame:
    info = _c("status.nodeInfo")

    def amount(side: str, what: str) -> Column:
        return F.coalesce(milli(_c(f"status.{side}")[what]), F.lit(0).cast("bigint"))

    return nodes.withColumn("_verdict", health.node_verdict(_c("metadata.name"), _c("status.conditions"))).select(
        *header(),
        text(_c("spec.podCIDR")).alias("pod_cidr"),
        usable_addresses(_c("spec.podCIDR")).alias("num_ips"),
        flag(_c("spec.unschedulable")).alias("unschedulable"),
        health.condition_holds(_c("status.conditions"), "Ready").alias("ready"),
        amount("capacity", "cpu").alias("cpu_capacity"),
        amount("allocatable", "cpu").alias("cpu_allocatable"),
        amount("capacity", "memory").alias("memory_capacity"),
        amount("allocatable", "memory").alias("memory_allocatable"),
        F.coalesce(whole(_c("status.allocatable")["pods"]), F.lit(0).cast("bigint")).alias("pod_capacity"),
        node_roles(_c("metadata.labels")).alias("roles"),
        text(info["machineID"]).alias("machine_id"),
        text(info["systemUUID"]).alias("system_uuid"),
        text(info["bootID"]).alias("boot_id"),
        text(info["kernelVersion"]).alias("kernel_version"),
        text(info["osImage"]).alias("os_image"),
        text(info["operatingSystem"]).alias("operating_system"),
        text(info["architecture"]).alias("architecture"),
        text(info["containerRuntimeVersion"]).alias("container_runtime_version"),
        text(info["kubeletVersion"]).alias("kubelet_version"),
        text(info["kubeProxyVersion"]).alias("kube_proxy_version"),
        *health_columns(_c("_verdict")),
        document(nodes),
    )


def node_volumes(nodes: DataFrame) -> DataFrame:
    keep = (_c("uuid").alias("node_uuid"), _c("status.volumesInUse").alias("used"))
    return exploded(nodes, "status.volumesAttached", *keep, names=("v",)).select(
        "node_uuid",
        _c("v.name").alias("name"),
        _c("v.devicePath").alias("device_path"),
        flag(F.array_contains("used", _c("v.name"))).alias("mounted"),
    )


# --------------------------------------------------------------------------- controllers


def deployment(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.deployment_verdict(
        _c("metadata.namespace"),
        _c("metadata.name"),
        _c("spec.replicas"),
        _c("status.availableReplicas"),
        _c("status.unavailableReplicas"),
    )
    return objects.withColumn("_verdict", verdict).select(
        *header(),
        text(_c("spec.strategy.type")).alias("strategy"),
        zero(_c("spec.minReadySeconds")).alias("min_ready_seconds"),
        zero(_c("spec.progressDeadlineSeconds")).alias("progress_deadline_seconds"),
        flag(_c("spec.paused")).alias("paused"),
        zero(_c("spec.replicas")).alias("desired_replicas"),
        zero(_c("status.replicas")).alias("actual_replicas"),
        zero(_c("status.updatedReplicas")).alias("updated_replicas"),
        zero(_c("status.readyReplicas")).alias("ready_replicas"),
        zero(_c("status.availableReplicas")).alias("available_replicas"),
        zero(_c("status.unavailableReplicas")).alias("unavailable_replicas"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def daemon_set(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.daemon_set_verdict(
        _c("metadata.namespace"),
        _c("metadata.name"),
        _c("status.desiredNumberScheduled"),
        _c("status.numberAvailable"),
    )
    return objects.withColumn("_verdict", verdict).select(
        *header(),
        text(_c("spec.updateStrategy.type")).alias("update_strategy"),
        zero(_c("spec.minReadySeconds")).alias("min_ready_seconds"),
        zero(_c("status.desiredNumberScheduled")).alias("desired_number_scheduled"),
        zero(_c("status.currentNumberScheduled")).alias("current_number_scheduled"),
        zero(_c("status.numberMisscheduled")).alias("number_misscheduled"),
        zero(_c("status.numberReady")).alias("number_ready"),
        zero(_c("status.updatedNumberScheduled")).alias("update_number_scheduled"),
        zero(_c("status.numberAvailable")).alias("number_available"),
        zero(_c("status.numberUnavailable")).alias("number_unavailable"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def replica_set(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.replica_set_verdict(
        _c("metadata.namespace"), _c("metadata.name"), _c("spec.replicas"), _c("status.availableReplicas")
    )
    return objects.withColumn("_verdict", verdict).select(
        *header(),
        zero(_c("spec.replicas")).alias("desired_replicas"),
        zero(_c("spec.minReadySeconds")).alias("min_ready_seconds"),
        zero(_c("status.replicas")).alias("actual_replicas"),
        zero(_c("status.fullyLabeledReplicas")).alias("fully_labeled_replicas"),
        zero(_c("status.readyReplicas")).alias("ready_replicas"),
        zero(_c("status.availableReplicas")).alias("available_replicas"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def stateful_set(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.stateful_set_verdict(
        _c("metadata.namespace"), _c("metadata.name"), _c("spec.replicas"), _c("status.availableReplicas")
    )
    retention = _c("spec.persistentVolumeClaimRetentionPolicy")

    def policy(event: str) -> Column:
        return F.when(retention.isNull(), "Retain").otherwise(text(retention[event]))

    return objects.withColumn("_verdict", verdict).select(
        *header(),
        zero(_c("spec.replicas")).alias("desired_replicas"),
        text(_c("spec.serviceName")).alias("service_name"),
        text(_c("spec.podManagementPolicy")).alias("pod_management_policy"),
        text(_c("spec.updateStrategy.type")).alias("update_strategy"),
        zero(_c("spec.minReadySeconds")).alias("min_ready_seconds"),
        policy("whenDeleted").alias("persistent_volume_claim_retention_policy_when_deleted"),
        policy("whenScaled").alias("persistent_volume_claim_retention_policy_when_scaled"),
        zero(_c("spec.ordinals.start")).alias("ordinals"),
        zero(_c("status.replicas")).alias("actual_replicas"),
        zero(_c("status.readyReplicas")).alias("ready_replicas"),
        zero(_c("status.currentReplicas")).alias("current_replicas"),
        zero(_c("status.updatedReplicas")).alias("updated_replicas"),
        zero(_c("status.availableReplicas")).alias("available_replicas"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def job(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.job_verdict(_c("metadata"), _c("spec"), _c("status"))
    return objects.withColumn("_verdict", verdict).select(
        *header(),
        _c("spec.parallelism").alias("parallelism"),
        _c("spec.completions").alias("completions"),
        _c("spec.activeDeadlineSeconds").alias("active_deadline_seconds"),
        _c("spec.backoffLimit").alias("backoff_limit"),
        _c("spec.ttlSecondsAfterFinished").alias("ttl_seconds_after_finished"),
        _c("spec.completionMode").alias("completion_mode"),
        _c("spec.suspend").alias("suspend"),
        _c("status.startTime").alias("start_time"),
        _c("status.completionTime").alias("completion_time"),
        zero(_c("status.active")).alias("active"),
        zero(_c("status.succeeded")).alias("succeeded"),
        zero(_c("status.failed")).alias("failed"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def cron_job(objects: DataFrame, now: Column) -> DataFrame:
    verdict = health.cron_job_verdict(
        _c("metadata.name"),
        _c("status.lastScheduleTime"),
        _c("status.lastSuccessfulTime"),
        _c("spec.startingDeadlineSeconds"),
        _c("spec.suspend"),
        now,
    )
    return objects.withColumn("_verdict", verdict).select(
        *header(),
        text(_c("spec.schedule")).alias("schedule"),
        _c("spec.timeZone").alias("timezone"),
        _c("spec.startingDeadlineSeconds").alias("starting_deadline_seconds"),
        text(_c("spec.concurrencyPolicy")).alias("concurrency_policy"),
        flag(_c("spec.suspend")).alias("suspend"),
        zero(_c("spec.successfulJobsHistoryLimit")).alias("successful_jobs_history_limit"),
        zero(_c("spec.failedJobsHistoryLimit")).alias("failed_jobs_history_limit"),
        F.coalesce(F.array_size("status.active"), F.lit(0)).alias("active"),
        _c("status.lastScheduleTime").alias("last_schedule_time"),
        _c("status.lastSuccessfulTime").alias("last_successful_time"),
        *health_columns(_c("_verdict")),
        document(objects),
    )


def kinds() -> list[Kind]:
    def controller(name: str, project, notifies: bool = True) -> Kind:
        return Kind(name, project, (conditions(name), owners(name), *tagging(name)), notifies=notifies)

    return [
        Kind(
            "node",
            node,
            (
                conditions("node"),
                Relation("node_volume", "node_uuid", ("node_uuid", "name"), node_volumes),
                *tagging("node"),
            ),
            notifies=True,
        ),
        controller("deployment", deployment),
        controller("daemon_set", daemon_set),
        controller("replica_set", replica_set),
        controller("stateful_set", stateful_set),
        controller("job", job, notifies=False),
        Kind("cron_job", cron_job, tagging("cron_job")),
    ]

"""Volumes, claims and the simple kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.ids import ensure_uuid
from clusterlens.functions.quantity import milli, mode_mask
from clusterlens.functions.text import nullable, text
from clusterlens.plans.common import Kind, Relation, conditions, document, flag, header, tagging, union_member
from clusterlens.schemas import PERSISTENT_VOLUME_OTHER, PERSISTENT_VOLUME_SPEC


def _c(path: str) -> Column:
    return F.col(path)


def pvc(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(
        *header(),
        mode_mask(_c("spec.accessModes")).alias("desired_access_modes"),
        mode_mask(_c("status.accessModes")).alias("actual_access_modes"),
        milli(_c("spec.resources.requests")["storage"]).alias("minimum_capacity"),
        milli(_c("status.capacity")["storage"]).alias("actual_capacity"),
        text(_c("status.phase")).alias("phase"),
        nullable(_c("spec.volumeName")).alias("volume_name"),
        F.coalesce(_c("spec.volumeMode"), F.lit("Filesystem")).alias("volume_mode"),
        _c("spec.storageClassName").alias("storage_class"),
        document(objects),
    )


def prepare_volume(objects: DataFrame, now: Column) -> DataFrame:
    """Split the raw spec into its known fields and the one volume source."""
    return objects.withColumn("known", F.from_json("spec", PERSISTENT_VOLUME_SPEC)).withColumn(
        "member", union_member(_c("spec"), PERSISTENT_VOLUME_OTHER)
    )


def persistent_volume(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(
        *header(),
        mode_mask(_c("known.accessModes")).alias("access_modes"),
        # Absent is 0; what does not fit is NULL, never 0.
        F.when(_c("known.capacity")["storage"].isNull(), F.lit(0).cast("bigint")).otherwise(milli(_c("known.capacity")["storage"])).alias("capacity"),
        text(_c("known.persistentVolumeReclaimPolicy")).alias("reclaim_policy"),
        nullable(_c("known.storageClassName")).alias("storage_class"),
        F.coalesce(_c("known.volumeMode"), F.lit("Filesystem")).alias("volume_mode"),
        _c("member.type").alias("volume_source_type"),
        _c("member.source").alias("volume_source"),
        text(_c("status.phase")).alias("phase"),
        nullable(_c("status.reason")).alias("reason"),
        nullable(_c("status.message")).alias("message"),
        document(objects),
    )


def claim_refs(objects: DataFrame) -> DataFrame:
    return objects.where(_c("known.claimRef").isNotNull()).select(
        _c("uuid").alias("persistent_volume_uuid"),
        text(_c("known.claimRef.kind")).alias("kind"),
        text(_c("known.claimRef.name")).alias("name"),
        text(_c("known.claimRef.uid")).alias("uid"),
    )


def namespace(objects: DataFrame, now: Column) -> DataFrame:
    return objects.select(*header(), text(_c("status.phase")).alias("phase"), document(objects))


def config_map(objects: DataFrame, now: Column) -> DataFrame:
    """The data itself is neither read nor stored."""
    return objects.select(*header(), flag(_c("immutable")).alias("immutable"))


def secret(objects: DataFrame, now: Column) -> DataFrame:
    """The data itself is neither read nor stored."""
    return objects.select(*header(), text(_c("type")).alias("type"), flag(_c("immutable")).alias("immutable"))


def event(objects: DataFrame, now: Column) -> DataFrame:
    first = F.coalesce(_c("eventTime"), _c("deprecatedFirstTimestamp"), _c("metadata.creationTimestamp"))
    last = F.coalesce(_c("series.lastObservedTime"), _c("deprecatedLastTimestamp"), first)
    return objects.select(
        *header(),
        ensure_uuid(_c("regarding.uid")).alias("reference_uuid"),
        nullable(_c("reportingController")).alias("reporting_controller"),
        nullable(_c("reportingInstance")).alias("reporting_instance"),
        nullable(_c("action")).alias("action"),
        text(_c("reason")).alias("reason"),
        text(_c("note")).alias("note"),
        text(_c("type")).alias("type"),
        text(_c("regarding.kind")).alias("reference_kind"),
        nullable(_c("regarding.namespace")).alias("reference_namespace"),
        text(_c("regarding.name")).alias("reference_name"),
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.greatest(_c("series.count"), _c("deprecatedCount"), F.lit(1)).alias("count"),
        document(objects),
    )


def cluster_row(namespaces: DataFrame, name: str | None = None) -> DataFrame:
    """The cluster is identified by the uid of its system name space."""
    return namespaces.where(_c("metadata.name") == "kube-system").select(
        ensure_uuid(_c("metadata.uid")).alias("uuid"), F.lit(name).cast("string").alias("name")
    )


def kinds() -> list[Kind]:
    volume = "persistent_volume"
    return [
        Kind("pvc", pvc, (conditions("pvc"), *tagging("pvc"))),
        Kind(
            volume,
            persistent_volume,
            (
                Relation(f"{volume}_claim_ref", f"{volume}_uuid", (f"{volume}_uuid", "uid"), claim_refs),
                *tagging(volume),
            ),
            prepare_volume,
        ),
        Kind("namespace", namespace, (conditions("namespace"), *tagging("namespace"))),
        Kind("config_map", config_map, tagging("config_map", favorite=False)),
        Kind("secret", secret, tagging("secret", favorite=False)),
        Kind("event", event),
    ]

"""Pieces every kind of object shares."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.ids import ensure_uuid, pair_uuid
from clusterlens.functions.state import state_name
from clusterlens.functions.text import snake_case, text

Build = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Relation:
    """A child table of a kind.

    ``build`` makes the child rows from identified objects; relations without it are only
    deleted along with their parent.  Rows of relations that do not ``cascade`` survive it.
    """

    table: str
    foreign_key: str
    primary_key: tuple[str, ...]
    build: Build | None = None
    cascade: bool = True
    children: tuple["Relation", ...] = ()


@dataclass(frozen=True)
class Kind:
    """Everything known about a kind of object: its projection, children and health."""

    name: str
    project: Callable[[DataFrame, Column], DataFrame]
    relations: tuple[Relation, ...] = ()
    prepare: Callable[[DataFrame, Column], DataFrame] = field(default=lambda objects, now: objects)
    notifies: bool = False

    def builders(self) -> dict[str, Build]:
        """What makes each child table from prepared objects."""
        relations = [r for parent in self.relations for r in (parent, *parent.children)]
        return {r.table: r.build for r in relations if r.build is not None}

    def prepared(self, objects: DataFrame, cluster: Column, now: Column) -> DataFrame:
        """Objects with their identifiers and whatever several of their tables need."""
        return self.prepare(identify(objects, cluster), now)

    def table(self, name: str, prepared: DataFrame, now: Column) -> DataFrame:
        """Rows of the kind's own or one of its child tables."""
        return self.project(prepared, now) if name == self.name else self.builders()[name](prepared)

    def tables(self, objects: DataFrame, cluster: Column, now: Column) -> dict[str, DataFrame]:
        """All table rows of the objects.  Persist ``objects`` if more than one table is used."""
        known = self.prepared(objects, cluster, now)
        return {name: self.table(name, known, now) for name in (self.name, *self.builders())}


def identify(objects: DataFrame, cluster: Column) -> DataFrame:
    """Add the object's and its cluster's identifier."""
    return objects.withColumn("uuid", ensure_uuid(F.col("metadata.uid"))).withColumn("cluster_uuid", cluster)


def header() -> list[Column]:
    """The columns every top-level table starts with."""
    return [
        F.col("uuid"),
        F.col("cluster_uuid"),
        F.col("metadata.uid").alias("uid"),
        text(F.col("metadata.namespace")).alias("namespace"),
        text(F.col("metadata.name")).alias("name"),
        text(F.col("metadata.resourceVersion")).alias("resource_version"),
        F.col("metadata.creationTimestamp").alias("created"),
    ]


def exploded(rows: DataFrame, source: Column | str, *keep: Column | str, names: tuple[str, ...] = ("item",)) -> DataFrame:
    """One row per element of an array (or entry of a map) column.

    The optimiser puts a test for emptiness below a plain explode, which evaluates the array
    (often: parses the document) twice.  The outer explode has no such test; the rows it adds
    for empty arrays are dropped here, as are NULL elements.
    """
    return rows.select(*keep, F.explode_outer(source).alias(*names)).where(F.col(names[0]).isNotNull())


def document(objects: DataFrame) -> Column:
    """The source document as it was read, if the reader kept it."""
    return (F.col("raw") if "raw" in objects.columns else F.lit(None).cast("string")).alias("document")


def health_columns(verdict: Column) -> list[Column]:
    return [state_name(verdict["rank"]).alias("health_state"), verdict["reason"].alias("health_reason")]


def zero(value: Column) -> Column:
    """An absent counter is 0."""
    return F.coalesce(value, F.lit(0))


def flag(value: Column, default: bool = False) -> Column:
    return F.coalesce(value, F.lit(default))


# --------------------------------------------------------------------------- labels and annotations


def _pairs(objects: DataFrame, source: str) -> DataFrame:
    return exploded(objects, source, "uuid", names=("name", "value")).select(
        F.col("uuid").alias("owner"), pair_uuid(F.col("uuid"), F.col("name"), F.col("value")).alias("uuid"), "name", "value"
    )


def dictionary(source: str) -> Build:
    """(uuid, name, value) entries of a map column."""
    return lambda objects: _pairs(objects, source).select("uuid", "name", "value")


def bridge(source: str, owner: str, entry: str) -> Build:
    """(owner, entry) pairs of a map column."""
    return lambda objects: _pairs(objects, source).select(F.col("owner").alias(owner), F.col("uuid").alias(entry))


def tagging(kind: str, *, annotations: bool = True, resource: bool = True, favorite: bool = True) -> tuple[Relation, ...]:
    """Label and annotation tables of a kind, and its favourites (never filled here, but deleted)."""
    found: list[Relation] = []
    for word, source in (("label", "metadata.labels"), ("annotation", "metadata.annotations")):
        if word == "annotation" and not annotations:
            continue
        entry = f"{word}_uuid"
        if resource:
            found.append(
                Relation(
                    f"resource_{word}", "resource_uuid", ("resource_uuid", entry), bridge(source, "resource_uuid", entry)
                )
            )
        found.append(Relation(word, "uuid", ("uuid",), dictionary(source), cascade=False))
        owner = f"{kind}_uuid"
        found.append(Relation(f"{kind}_{word}", owner, (owner, entry), bridge(source, owner, entry)))
    if favorite:
        found.append(Relation("favorite", "resource_uuid", ("resource_uuid", "username")))
    return tuple(found)


# --------------------------------------------------------------------------- owners and conditions


def owners(kind: str) -> Relation:
    key = f"{kind}_uuid"

    def build(objects: DataFrame) -> DataFrame:
        return exploded(objects, "metadata.ownerReferences", F.col("uuid").alias(key), names=("o",)).select(
            key,
            ensure_uuid(F.col("o.uid")).alias("owner_uuid"),
            snake_case(F.col("o.kind")).alias("kind"),
            F.col("o.name").alias("name"),
            F.col("o.uid").alias("uid"),
            flag(F.col("o.controller")).alias("controller"),
            flag(F.col("o.blockOwnerDeletion")).alias("block_owner_deletion"),
        )

    return Relation(f"{kind}_owner", key, (key, "owner_uuid"), build)


# Condition columns that only some kinds have.
CONDITION_TIMES: Mapping[str, tuple[tuple[str, str], ...]] = {
    "pod": (("last_probe", "lastProbeTime"), ("last_transition", "lastTransitionTime")),
    "node": (("last_heartbeat", "lastHeartbeatTime"), ("last_transition", "lastTransitionTime")),
    "job": (("last_probe", "lastProbeTime"), ("last_transition", "lastTransitionTime")),
    "deployment": (("last_update", "lastUpdateTime"), ("last_transition", "lastTransitionTime")),
    "daemon_set": (("last_transition", "lastTransitionTime"),),
    "replica_set": (("last_transition", "lastTransitionTime"),),
    "stateful_set": (("last_transition", "lastTransitionTime"),),
    "namespace": (("last_transition", "lastTransitionTime"),),
    "pvc": (("last_probe", "lastProbeTime"), ("last_transition", "lastTransitionTime")),
    "service": (("observed_generation", "observedGeneration"), ("last_transition", "lastTransitionTime")),
}


def conditions(kind: str) -> Relation:
    """Condition rows.  The status is stored lower case."""
    key = f"{kind}_uuid"

    def build(objects: DataFrame) -> DataFrame:
        type_name = snake_case(F.col("c.type")) if kind == "pvc" else F.col("c.type")
        return exploded(objects, "status.conditions", F.col("uuid").alias(key), names=("c",)).select(
            key,
            type_name.alias("type"),
            F.lower("c.status").alias("status"),
            *[F.col(f"c.{field_}").alias(name) for name, field_ in CONDITION_TIMES[kind]],
            text(F.col("c.reason")).alias("reason"),
            text(F.col("c.message")).alias("message"),
        )

    return Relation(f"{kind}_condition", key, (key, "type"), build)


# --------------------------------------------------------------------------- unions

# Field names whose type name is not just the field name with a capital.
UNION_NAMES = {
    "gcePersistentDisk": "GCEPersistentDisk",
    "awsElasticBlockStore": "AWSElasticBlockStore",
    "nfs": "NFS",
    "iscsi": "ISCSI",
    "rbd": "RBD",
    "cephfs": "CephFS",
    "fc": "FC",
    "storageos": "StorageOS",
    "csi": "CSI",
}


def union_member(source: Column, other: Sequence[str]) -> Column:
    """The set member of a one-of JSON object: ``struct<type, source>``, both '' if none is set.

    ``other`` names fields of the object that are not members.
    """
    members = F.map_filter(
        F.from_json(source, "map<string,string>"), lambda k, v: v.isNotNull() & ~k.isin(*other)
    )
    name = F.try_element_at(F.map_keys(members), F.lit(1))
    special = F.element_at(F.create_map(*[F.lit(x) for pair in UNION_NAMES.items() for x in pair]), name)
    plain = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    return F.struct(
        F.coalesce(special, plain, F.lit("")).alias("type"),
        F.coalesce(F.try_element_at(F.map_values(members), F.lit(1)), F.lit("")).alias("source"),
    )

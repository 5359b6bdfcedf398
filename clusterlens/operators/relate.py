"""Joins between objects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from clusterlens.functions.ids import ensure_uuid
from clusterlens.session import scratch_dir
from clusterlens.sources.tables import few

_NS = "_namespace"


def _signature(entries: Column) -> Column:
    """64 bits, of which each entry sets one: those of some of the entries are among those of all."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(e), F.lit(64)).cast("int"))
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda bits, e: bits.bitwiseOR(bit(e)))


def select_pods(
    services: DataFrame,
    pods: DataFrame,
    *,
    same_namespace: bool = True,
    within: Sequence[str] = (),
    service_key: str = "service_uuid",
    pod_key: str = "pod_uuid",
) -> DataFrame:
    """Pairs (service, pod) where every selector entry is among the pod's labels.

    ``services``: key, ``selector`` map, ``namespace``; ``pods``: key, ``labels`` map,
    ``namespace``.  Services without a selector select nothing.  ``within`` names columns of
    both sides that have to be equal as well, such as the cluster.

    Containment is checked on one join candidate per pod and selector: each selector is
    joined on its *rarest* entry and the others are then tested in the row.  Equal selectors
    are matched once.  So a label nearly all pods carry costs nothing unless a selector
    consists of nothing rarer, in which case its matches are the result itself.  A signature of
    all labels goes along with every entry, so that most candidates whose labels do not cover the
    selector end where they are found, and are not sorted together with the labels of their pods.
    """
    scope = [*within, _NS] if same_namespace else [*within]

    def scoped(rows: DataFrame, key: str, entries: str) -> DataFrame:
        namespace = [F.col("namespace").alias(_NS)] if same_namespace else []
        return rows.select(key, *within, *namespace, entries)

    wanted = (
        scoped(services, service_key, "selector")
        .where(F.size("selector") > 0)
        .withColumn("terms", F.sort_array(F.map_entries("selector")))
        .drop("selector")
    )
    selectors = wanted.select(*scope, "terms").distinct()
    terms = selectors.select(*scope, "terms", F.explode("terms").alias("term"))

    labelled = scoped(pods, pod_key, "labels")
    listed = F.map_entries("labels")
    entries = labelled.select(pod_key, *scope, _signature(listed).alias("has"), F.explode(listed).alias("term"))

    # How many pods carry each entry.  Counted before any join, so that tasks send one row per
    # entry they have seen, however many pods carry it.
    on = [*scope, "term"]
    carriers = entries.groupBy(*on).count()

    # A term nobody carries rules its selector out: it has no count and the sizes differ.
    anchors = (
        terms.join(carriers, on)
        .groupBy(*scope, "terms")
        .agg(F.min_by("term", F.struct("count", "term")).alias("term"), F.count(F.lit(1)).alias("found"))
        .where(F.col("found") == F.size("terms"))
        .drop("found")
        .withColumn("needs", _signature(F.col("terms")))
    )
    # Candidates are keys only; the labels come back by the pod's key, which is never hot.
    likely = F.col("has").bitwiseAND(F.col("needs")) == F.col("needs")
    # Files of a few megabytes hold a gigabyte of labels, as they compress so well: it is the selectors that are broadcast, if a
    # count says that they are few, and neither entries nor labels of pods, whatever size is expected of them.
    how = "broadcast" if few(selectors) else "merge"
    candidates = entries.join(anchors.hint(how), on).where(likely).select(pod_key, *scope, "terms")
    covered = F.forall("terms", lambda t: F.coalesce(F.element_at("labels", t["key"]) == t["value"], F.lit(False)))
    candidates = candidates.join(labelled.select(pod_key, *scope, "labels").hint("merge"), [pod_key, *scope])
    matches = candidates.where(covered).select(pod_key, *scope, "terms")
    return matches.join(wanted, [*scope, "terms"]).select(service_key, pod_key)


def node_names(nodes: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Look-up rows (node, node_uuid) by node name and by internal address.

    ``nodes``: ``uuid``, ``name``, ``addresses`` array of (type, address).  Names are unique
    within the columns ``within`` only, such as the cluster.
    """
    internal = F.filter("addresses", lambda a: a["type"] == "InternalIP")
    names = F.concat(F.array("name"), F.coalesce(F.transform(internal, lambda a: a["address"]), F.array().cast("array<string>")))
    listed = nodes.select(*within, F.explode(names).alias("node"), F.col("uuid").alias("node_uuid"))
    # A name that is also another node's address must not multiply samples.
    return listed.groupBy(*within, "node").agg(F.max("node_uuid").alias("node_uuid"))


def orphans(references: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """References (``resource``, ``uuid``, ...) whose object is in no table of its kind.

    Fails closed: a reference of a kind without a table raises when the result is computed,
    rather than being taken for an orphan.
    """
    known = F.array(*[F.lit(k) for k in sorted(tables)])
    checked = references.withColumn(
        "resource",
        F.when(F.array_contains(known, F.col("resource")), F.col("resource")).otherwise(
            F.raise_error(F.concat(F.lit("no table to look references up in: "), F.coalesce(F.col("resource"), F.lit("NULL"))))
        ),
    )
    live = reduce(
        DataFrame.unionByName,
        [table.select(F.lit(kind).alias("resource"), "uuid") for kind, table in sorted(tables.items())],
    )
    return checked.join(live, ["resource", "uuid"], "left_anti")


# Tables of owner references: the object's column; its owner is ``owner_uuid``.
OWNER_SUFFIX = "_owner"

# Tables that refer to another object by name within their parent's name space: parent and its column, name, target, relation.
NAMED_REFERENCES = {
    "pod_pvc": ("pod", "pod_uuid", "claim_name", "pvc", "claim"),
    "ingress_backend_service": ("ingress", "ingress_uuid", "service_name", "service", "backend"),
}

# Tables that refer to another object by uid: column of the object, relation.
UID_REFERENCES = {
    "persistent_volume_claim_ref": ("persistent_volume_uuid", "claim"),
    "endpoint_target_ref": ("endpoint_slice_uuid", "target"),
}


def object_edges(tables: Mapping[str, DataFrame], identify: Callable[[Column], Column] = ensure_uuid) -> DataFrame:
    """Edges (child, owner, relation) between objects, from those of the stored tables that are given.

    Pods and other objects to their owners, volumes and pods to claims, ingresses to services, endpoint slices to
    their targets.  ``identify`` turns a uid into the identifier of a stored row.  References by name need the
    tables of both objects; one that names no stored object is no edge.
    """
    found = []
    for name, table in sorted(tables.items()):
        if name.endswith(OWNER_SUFFIX):
            child = f"{name.removesuffix(OWNER_SUFFIX)}_uuid"
            found.append(table.select(F.col(child).alias("child"), F.col("owner_uuid").alias("owner"), F.lit("owner").alias("relation")))
        elif name in UID_REFERENCES:
            child, relation = UID_REFERENCES[name]
            found.append(table.select(F.col(child).alias("child"), identify(F.col("uid")).alias("owner"), F.lit(relation).alias("relation")))
        elif name in NAMED_REFERENCES:
            parent, child, label, target, relation = NAMED_REFERENCES[name]
            if parent not in tables or target not in tables:
                continue
            place = ["cluster_uuid", "namespace"]
            parents = tables[parent].select(F.col("uuid").alias("child"), *place)
            targets = tables[target].select(F.col("uuid").alias("owner"), *place, F.col("name").alias("_name"))
            named = table.select(F.col(child).alias("child"), F.col(label).alias("_name")).join(parents, "child")
            found.append(named.join(targets, [*place, "_name"]).select("child", "owner", F.lit(relation).alias("relation")))
    edges = reduce(DataFrame.unionByName, found)
    return edges.where("child IS NOT NULL AND owner IS NOT NULL").distinct()


def reachable(edges: DataFrame) -> DataFrame:
    """All (child, ancestor, distance) triples over any number of edges (child, owner), by path doubling.

    After round r all pairs within 2^r edges are known.  A shortest path of up to twice that has an object exactly
    2^r edges on, so the next round joins the pairs at that distance with the known ones; a chain of 1,000
    takes ten rounds.  A pair counts with its shortest distance, which also ends the search where edges form a
    cycle.  Every round is written to the shared folder once and counts what the next one needs as it goes.
    """
    spark = edges.sparkSession
    folder = scratch_dir(spark, "reachable")
    kind = edges.schema["child"].dataType.simpleString()
    schema = f"child {kind}, ancestor {kind}, distance INT"
    fresh = edges.select("child", F.col("owner").alias("ancestor"), F.lit(1).alias("distance"))
    fresh = fresh.where("child IS NOT NULL AND ancestor IS NOT NULL").distinct()
    reach = 1
    while True:
        seen = Observation()
        marked = fresh.observe(seen, F.count_if(F.col("distance") == reach).alias("farthest"))
        marked.write.mode("overwrite").parquet(f"{folder}/reach={reach}")
        known = spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/reach=*").select("child", "ancestor", "distance")
        if not seen.get["farthest"]:
            return known
        far = known.where(F.col("distance") == reach).select("child", F.col("ancestor").alias("_via"))
        onward = known.select(F.col("child").alias("_via"), "ancestor", (F.col("distance") + reach).alias("distance"))
        found = far.join(onward, "_via").groupBy("child", "ancestor").agg(F.min("distance").alias("distance"))
        fresh = found.join(known.select("child", "ancestor"), ["child", "ancestor"], "left_anti")
        reach *= 2


def containers_of(containers: DataFrame, pods: DataFrame) -> DataFrame:
    """Containers (of every role) that belong to the given pods."""
    return containers.join(pods.select(F.col("uuid").alias("pod_uuid")), "pod_uuid", "left_semi")

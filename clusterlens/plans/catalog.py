"""The metric library: named metrics on cluster, node, pod and container level."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from clusterlens.functions.ids import uuid5
from clusterlens.functions.text import host_of, label_replace
from clusterlens.operators import metrics as m
from clusterlens.session import scratch_dir

# What the matchers leave out.
IDLE_MODES = "idle|iowait|steal"
VIRTUAL_DEVICES = "(veth|azv|lxc).*"

# Source metrics.
NODE_INFO = "kube_node_info"
NAMESPACE_CREATED = "kube_namespace_created"
POD_PHASE = "kube_pod_status_phase"
POD_QOS = "kube_pod_status_qos_class"
NODE_CPU = "node_cpu_seconds_total"
MEMORY_TOTAL = "node_memory_MemTotal_bytes"
MEMORY_FREE = "node_memory_MemAvailable_bytes"
RECEIVED = "node_network_receive_bytes_total"
TRANSMITTED = "node_network_transmit_bytes_total"
DISK_FREE = "node_filesystem_avail_bytes"
DISK_SIZE = "node_filesystem_size_bytes"
CONTAINER_CPU = "container_cpu_usage_seconds_total"
CONTAINER_MEMORY = "container_memory_usage_bytes"
REQUESTS = "kube_pod_container_resource_requests"
LIMITS = "kube_pod_container_resource_limits"
NODE_CORES = "machine_cpu_cores"
NODE_MEMORY = "machine_memory_bytes"

CLUSTER, NODE, POD, CONTAINER = "cluster", "node", "pod", "container"


# Labels of the source metrics that the library groups by or matches.
LABELS = {
    POD_PHASE: ("phase",),
    POD_QOS: ("qos_class",),
    NODE_CPU: ("instance", "node", "cpu", "mode"),
    MEMORY_TOTAL: ("instance", "node"),
    RECEIVED: ("node", "device"),
    TRANSMITTED: ("node", "device"),
    CONTAINER_CPU: ("instance", "namespace", "pod"),
    CONTAINER_MEMORY: ("instance", "namespace", "pod"),
    REQUESTS: ("resource", "node", "namespace", "pod", "container"),
    LIMITS: ("resource", "node", "namespace", "pod", "container"),
    NODE_CORES: ("node",),
    NODE_MEMORY: ("node",),
}


# Labels that requests and limits are summed up by, and what is allocated: source metric, resource and capacity of the node.
ALLOCATED_BY = {NODE: ("node",), POD: ("node", "namespace", "pod"), CONTAINER: ("node", "namespace", "pod", "container")}
ALLOCATED = {
    "cpu.request": (REQUESTS, "cpu", NODE_CORES),
    "cpu.limit": (LIMITS, "cpu", NODE_CORES),
    "memory.request": (REQUESTS, "memory", NODE_MEMORY),
    "memory.limit": (LIMITS, "memory", NODE_MEMORY),
}
_PERCENTAGE = ".percentage"


class Shared:
    """Samples of which several metrics are evaluated.

    Per source metric (and window, for rates) the sums over all labels that the library uses are
    computed once and written to the shared folder; metrics match and sum up those rows.  Requests, limits and
    capacities of nodes are put side by side, one row per labels and tick.  Samples of one ``level`` only are summed up
    by its own labels at once.
    """

    def __init__(self, frame: DataFrame, level: str = "") -> None:
        self.frame, self.level = frame, level
        self._found: dict[str, DataFrame] = {}

    def _written(self, key: str, rows: DataFrame) -> DataFrame:
        if key not in self._found:
            folder = scratch_dir(self.frame.sparkSession, "metrics")
            rows.write.parquet(folder)
            self._found[key] = self.frame.sparkSession.read.schema(rows.schema).parquet(folder)
        return self._found[key]

    def allocated(self, level: str, **grid) -> DataFrame:
        """Requests and limits by the labels of a level: a column per key of ``ALLOCATED``."""
        scope, by = _scope(grid), ALLOCATED_BY[level]
        finest = by if self.level else ALLOCATED_BY[CONTAINER]
        known = [m.equals("resource", r) for r in ("cpu", "memory")]
        vectors = m.instants(self.frame, [REQUESTS, LIMITS], [*finest, "resource"], [known[0] | known[1]], **grid)
        value = {c: F.when((F.col("metric") == source) & (F.col("resource") == r), F.col("value")) for c, (source, r, _) in ALLOCATED.items()}
        rows = vectors.groupBy(*scope, *finest, "tick").agg(*[F.sum(v).alias(c) for c, v in value.items()])
        if self.level:
            return rows
        rows = self._written(f"allocated {grid}", rows)
        if by == finest:
            return rows
        return rows.groupBy(*scope, *by, "tick").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in ALLOCATED])

    def capacities(self, **grid) -> DataFrame:
        """CPU cores and memory per node: a column per metric."""
        sources = [NODE_CORES, NODE_MEMORY]
        vectors = m.instants(self.frame, sources, ["node"], **grid)
        sums = [F.sum(F.when(F.col("metric") == source, F.col("value"))).alias(source) for source in sources]
        rows = vectors.groupBy(*_scope(grid), "node", "tick").agg(*sums)
        return rows if self.level else self._written(f"capacities {grid}", rows)

    def _base(self, key: str, metric: str, vector: Callable[[], DataFrame], scope: Sequence[str]) -> DataFrame:
        if key not in self._found:
            by = LABELS[metric]
            folder = scratch_dir(self.frame.sparkSession, "metrics")
            m.sum_by(vector(), by, scope).write.parquet(folder)
            rows = self.frame.sparkSession.read.parquet(folder)
            self._found[key] = rows.withColumn("labels", F.create_map(*[x for name in by for x in (F.lit(name), F.col(name))]))
        return self._found[key]

    def sums(self, metric: str, **grid) -> DataFrame:
        return self._base(f"{metric} {grid}", metric, lambda: m.instant(self.frame, metric, LABELS[metric], **grid), _scope(grid))

    def rates(self, metric: str, minutes: int, **grid) -> DataFrame:
        window = minutes * m.MINUTE
        return self._base(f"{metric} {minutes} {grid}", metric, lambda: m.rate(self.frame, metric, window, LABELS[metric], **grid), _scope(grid))


def _frame(samples: DataFrame | Shared) -> DataFrame:
    return samples.frame if isinstance(samples, Shared) else samples


def _matching(rows: DataFrame, matchers: Sequence[Column]) -> DataFrame:
    return reduce(DataFrame.where, matchers, rows)


@dataclass(frozen=True)
class Metric:
    """One named metric: ``build(samples, **grid)`` gives its vector."""

    id: str
    level: str
    category: str
    build: Callable[..., DataFrame]
    name_label: str = ""
    sources: tuple[str, ...] = ()


def _scope(grid: dict) -> Sequence[str]:
    return grid.get("scope", ())


def _sum_shared(rows: DataFrame, metric: str, by: Sequence[str], scope: Sequence[str]) -> DataFrame:
    """Shared rows are unique per label values and tick: by all their labels there is nothing left to sum up."""
    if set(by) == set(LABELS[metric]):
        return rows.select(*scope, *by, "tick", "value")
    return m.sum_by(rows, by, scope)


def _sum(metric: str, by: Sequence[str], *matchers: Column) -> Callable[..., DataFrame]:
    def build(samples: DataFrame | Shared, **grid) -> DataFrame:
        if isinstance(samples, Shared):
            return _sum_shared(_matching(samples.sums(metric, **grid), matchers), metric, by, _scope(grid))
        return m.sum_by(m.instant(samples, metric, by, matchers, **grid), by, _scope(grid))

    return build


def _rate(metric: str, minutes: int, by: Sequence[str], *matchers: Column, sign: int = 1) -> Callable[..., DataFrame]:
    def build(samples: DataFrame, **grid) -> DataFrame:
        grid.pop("lookback", None)
        if isinstance(samples, Shared):
            vector = _sum_shared(_matching(samples.rates(metric, minutes, **grid), matchers), metric, by, _scope(grid))
        else:
            vector = m.sum_by(m.rate(samples, metric, minutes * m.MINUTE, by, matchers, **grid), by, _scope(grid))
        return vector if sign > 0 else m.negate(vector)

    return build


def _cpu(minutes: int, inner: Sequence[str], outer: Sequence[str]) -> Callable[..., DataFrame]:
    """Average over CPUs of the busy time of each."""
    per_cpu = _rate(NODE_CPU, minutes, inner, m.not_matching("mode", IDLE_MODES))

    def build(samples: DataFrame, **grid) -> DataFrame:
        return m.avg_by(per_cpu(samples, **grid), outer, _scope(grid))

    return build


def _memory_share(by: Sequence[str]) -> Callable[..., DataFrame]:
    """sum(total - available) / sum(total); the two sums run over their own series."""

    def build(samples: DataFrame, **grid) -> DataFrame:
        used = m.matched(_frame(samples), MEMORY_TOTAL, MEMORY_FREE, by, F.col("left") - F.col("right"), **grid)
        scope = _scope(grid)
        return m.divide(m.sum_by(used, by, scope), _sum(MEMORY_TOTAL, by)(samples, **grid), by, scope)

    return build


def _share(amount: Callable[..., DataFrame], capacity: str) -> Callable[..., DataFrame]:
    """An amount per node (and more labels) over the capacity of the node."""
    whole = _sum(capacity, ["node"])

    def build(samples: DataFrame, **grid) -> DataFrame:
        return m.divide(amount(samples, **grid), whole(samples, **grid), ["node"], _scope(grid))

    return build


def _pod_memory_share(samples: DataFrame, **grid) -> DataFrame:
    """Pod memory over the memory of its node, whose name is taken over as ``instance``."""
    scope = _scope(grid)
    used = _sum(CONTAINER_MEMORY, ["instance", "namespace", "pod"])(samples, **grid)
    total = _sum(MEMORY_TOTAL, ["node"])(samples, **grid)
    # Nodes without a label all map to the same, empty instance, which would not be unique.
    renamed = total.withColumn("instance", label_replace(F.col("node"), "(.*)", 1)).drop("node")
    return m.divide(used, renamed, ["instance"], scope)


def _disk(samples: DataFrame, **grid) -> DataFrame:
    by = ["node", "mountpoint"]
    free = m.matched(_frame(samples), DISK_FREE, DISK_SIZE, by, 1 - F.try_divide("left", "right"), **grid)
    return m.sum_by(free.where(F.col("value").isNotNull()), by, _scope(grid))


def _node_count(samples: DataFrame, **grid) -> DataFrame:
    return m.count_groups(m.instant(_frame(samples), NODE_INFO, ["node"], **grid), ["node"], _scope(grid))


def _namespace_count(samples: DataFrame, **grid) -> DataFrame:
    return m.count_series(m.instant(_frame(samples), NAMESPACE_CREATED, **grid), (), _scope(grid))


def _allocations(prefix: str, level: str, first: int) -> list[Metric]:
    """Requests and limits of CPU and memory, each as an amount and as a share of the node."""
    found, number = [], first
    for category, (source, resource, capacity) in ALLOCATED.items():
        amount = _sum(source, ALLOCATED_BY[level], m.equals("resource", resource))
        found.append(Metric(f"{prefix}{number:02d}", level, category, amount, sources=(source,)))
        share = f"{category}{_PERCENTAGE}"
        found.append(Metric(f"{prefix}{number + 1:02d}", level, share, _share(amount, capacity), sources=(source, capacity)))
        number += 2
        if prefix == "N" and category == "cpu.limit":
            number += 1  # N06 is the memory usage
    return found


def _catalog() -> list[Metric]:
    physical = m.not_matching("device", VIRTUAL_DEVICES)
    entries = [
        Metric("C01", CLUSTER, "node.count", _node_count, sources=(NODE_INFO,)),
        Metric("C02", CLUSTER, "namespace.count", _namespace_count, sources=(NAMESPACE_CREATED,)),
    ]
    for number, phase in enumerate(("Running", "Pending", "Failed", "Succeeded"), start=3):
        build = _sum(POD_PHASE, [], m.equals("phase", phase))
        entries.append(Metric(f"C{number:02d}", CLUSTER, f"pod.{phase.lower()}", build, sources=(POD_PHASE,)))
    entries += [
        Metric("C07", CLUSTER, "cpu.usage", _cpu(1, ["instance", "cpu"], []), sources=(NODE_CPU,)),
        Metric("C08", CLUSTER, "memory.usage", _memory_share([]), sources=(MEMORY_TOTAL, MEMORY_FREE)),
        Metric("C09", CLUSTER, "qos_by_class", _sum(POD_QOS, ["qos_class"]), "qos_class", (POD_QOS,)),
        Metric("C10", CLUSTER, "network.received.bytes", _rate(RECEIVED, 2, [], physical), sources=(RECEIVED,)),
        Metric(
            "C11",
            CLUSTER,
            "network.transmitted.bytes",
            _rate(TRANSMITTED, 2, [], physical, sign=-1),
            sources=(TRANSMITTED,),
        ),
        Metric(
            "C12",
            CLUSTER,
            "network.received.bytes.bydevice",
            _rate(RECEIVED, 2, ["device"], physical),
            "device",
            (RECEIVED,),
        ),
        Metric("N01", NODE, "cpu.usage", _cpu(2, ["node", "cpu"], ["node"]), sources=(NODE_CPU,)),
        *_allocations("N", NODE, 2),
        Metric("N06", NODE, "memory.usage", _memory_share(["instance"]), sources=(MEMORY_TOTAL, MEMORY_FREE)),
        Metric("N11", NODE, "network.received.bytes", _rate(RECEIVED, 2, ["node"]), sources=(RECEIVED,)),
        Metric(
            "N12", NODE, "network.transmitted.bytes", _rate(TRANSMITTED, 2, ["node"], sign=-1), sources=(TRANSMITTED,)
        ),
        Metric("N13", NODE, "filesystem.usage", _disk, "mountpoint", (DISK_FREE, DISK_SIZE)),
        Metric(
            "P01", POD, "cpu.usage", _rate(CONTAINER_CPU, 2, ["instance", "namespace", "pod"]), sources=(CONTAINER_CPU,)
        ),
        Metric("P02", POD, "memory.usage", _pod_memory_share, sources=(CONTAINER_MEMORY, MEMORY_TOTAL)),
        Metric("P03", POD, "cpu.usage.cores", _rate(CONTAINER_CPU, 2, ["namespace", "pod"]), sources=(CONTAINER_CPU,)),
        Metric("P04", POD, "memory.usage.bytes", _sum(CONTAINER_MEMORY, ["namespace", "pod"]), sources=(CONTAINER_MEMORY,)),
        *_allocations("P", POD, 5),
        *_allocations("K", CONTAINER, 1),
    ]
    return sorted(entries, key=lambda e: ("CNPK".index(e.id[0]), e.id))


def catalog() -> dict[str, Metric]:
    """All metrics by id, in catalogue order (C, N, P, K).

    A function, not a constant: column expressions need a running session.
    """
    return {entry.id: entry for entry in _catalog()}


def vector(metric: Metric, samples: DataFrame | Shared, **grid) -> DataFrame:
    """The metric's vector without undefined values."""
    return metric.build(samples, **grid).where(F.col("value").isNotNull() & ~F.isnan("value"))


def node_key() -> Column:
    """What a node sample is looked up by: its node label, else the host of its instance."""
    return F.coalesce(F.nullif(F.col("node"), F.lit("")), host_of(F.col("instance")))


def metric_rows(
    metric: Metric,
    values: DataFrame,
    *,
    cluster: Column | None = None,
    nodes: DataFrame | None = None,
    pods: DataFrame | None = None,
    scope: Sequence[str] = (),
    step: int = 0,
) -> DataFrame:
    """Vector -> (entity_uuid, timestamp, category, name, value).

    Node values need ``nodes`` (node, node_uuid), pod and container values ``pods``
    (namespace, pod, pod_uuid), each unique per key within ``scope``.  Values of unknown
    entities are dropped.  The values are aggregated before they get here, so the look-up
    joins a small side; the optimiser broadcasts the dimension if its measured size allows.
    The key of the result is entity, minute, category and name.  Of several values the one of
    the latest tick counts, and at one tick (a pod seen through two instances) the highest.
    ``step``: that of the grid, if it is known.
    """
    found = _entities(metric.level, values, cluster=cluster, nodes=nodes, pods=pods, scope=scope)
    name = F.col(metric.name_label) if metric.name_label else F.lit("")
    rows = found.select("entity_uuid", _timestamp(), F.lit(metric.category).alias("category"), name.alias("name"), "tick", "value")
    return rows.groupBy("entity_uuid", "timestamp", "category", "name").agg(_last("value", step).alias("value"))


def _timestamp() -> Column:
    return (F.floor(F.col("tick") / F.lit(m.MINUTE)) * F.lit(m.MINUTE)).cast("bigint").alias("timestamp")


def _last(value: str, step: int) -> Column:
    """The value of a minute's latest tick, at one tick the highest.  Steps of whole minutes have one tick a minute."""
    if step and step % m.MINUTE == 0:
        return F.max(value)
    return F.max_by(value, F.struct("tick", value))


def _entities(
    level: str, values: DataFrame, *, cluster: Column | None = None, nodes: DataFrame | None = None, pods: DataFrame | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Values with the ``entity_uuid`` they belong to."""
    if level == CLUSTER:
        return values.withColumn("entity_uuid", cluster if cluster is not None else F.col("cluster_uuid"))
    if level == NODE:
        for absent in {"node", "instance"} - set(values.columns):
            values = values.withColumn(absent, F.lit(""))
        looked_up = values.withColumn("node", node_key())
        return looked_up.join(nodes, [*scope, "node"]).withColumnRenamed("node_uuid", "entity_uuid")
    found = values.where(F.col("pod") != "").join(pods, [*scope, "namespace", "pod"])
    return found.withColumn("entity_uuid", F.col("pod_uuid") if level == POD else uuid5(F.col("pod_uuid"), F.col("container")))

def _allocation_rows(level: str, categories: Sequence[str], shared: Shared, grid: dict, **lookups) -> DataFrame:
    """:func:`metric_rows` of all allocation metrics of a level.

    A row carries all of them through the look-up joins and the last aggregation, and becomes a row per category at the end.
    """
    scope = _scope(grid)
    values = shared.allocated(level, **grid).join(shared.capacities(**grid), [*scope, "node", "tick"], "left")

    def value(category: str) -> Column:
        amount = category.removesuffix(_PERCENTAGE)
        found = F.col(f"`{amount}`")
        if amount != category:
            found = F.try_divide(found, F.col(ALLOCATED[amount][2]))
        return F.when(~F.isnan(found), found)

    def newest(name: str) -> Column:
        """Of the minute's ticks at which the metric has a value."""
        if grid.get("step", m.MINUTE) % m.MINUTE == 0:
            return _last(name, m.MINUTE)
        return F.max(F.when(F.col(name).isNotNull(), F.struct("tick", name)))[name]

    names = {f"value_{n}": category for n, category in enumerate(categories)}
    values = values.select(*scope, *ALLOCATED_BY[level], "tick", *[value(c).alias(n) for n, c in names.items()])
    rows = _entities(level, values, scope=scope, **lookups).select("entity_uuid", _timestamp(), "tick", *names)
    last = rows.groupBy("entity_uuid", "timestamp").agg(*[newest(n).alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit("").alias("name"), F.col(n).alias("value")) for n, c in names.items()])
    return last.select("entity_uuid", "timestamp", F.inline(each)).where(F.col("value").isNotNull())


def level_rows(level: str, samples: DataFrame | Shared, *, grid: dict | None = None, **lookups) -> DataFrame:
    """All metrics of a level, ready for the keyed upsert.

    What several metrics start from is evaluated once; hand in one :class:`Shared` to share it between levels.
    """
    grid = dict(grid or {})
    shared = samples if isinstance(samples, Shared) else Shared(samples, level)
    entries = [entry for entry in catalog().values() if entry.level == level]
    allocated = [e.category for e in entries if e.category.removesuffix(_PERCENTAGE) in ALLOCATED]
    step = grid.get("step", m.MINUTE)
    parts = [
        metric_rows(entry, vector(entry, shared, **grid), scope=_scope(grid), step=step, **lookups) for entry in entries if entry.category not in allocated
    ]
    if allocated:
        parts.append(_allocation_rows(level, allocated, shared, grid, **lookups))
    return reduce(DataFrame.unionByName, parts)

"""Metric evaluation and the metric library.

The SQL counterparts are written the direct way, not the way the operators work: every
sample is joined to every tick that sees it, and windows are taken per tick.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from clusterlens.checks.base import query, sql_uuid5
from clusterlens.checks.views import EVENT_COLUMNS, SAMPLES, event_samples, metric_samples, sql_metric
from clusterlens.operators import merge, metrics as m, relate
from clusterlens.plans import catalog as c

HOUR = 3_600_000
DIGITS = 6

# Both sides are shifted by this before rounding: many values end in a 5 at the seventh digit,
# where two engines round a differing last bit to different sides.
SHIFT = 1.23e-8


def rounded(vector: DataFrame) -> DataFrame:
    return vector.withColumn("value", F.round(F.col("value") + F.lit(SHIFT), DIGITS))


# --------------------------------------------------------------------------- SQL building blocks


def sql_ticks(samples: str, reach: int, step: int) -> str:
    """Samples (labels..., t, v) with every tick that sees them."""
    first = f"CAST(ceil(t / {step}.0) AS BIGINT) * {step}"
    return f"SELECT *, unnest(range({first}, t + {reach}, {step})) AS tick FROM ({samples})"


def sql_instant(samples: str, labels: tuple[str, ...], reach: int = m.LOOKBACK, step: int = m.MINUTE) -> str:
    keys = ", ".join([*labels, "tick"])
    return (
        f"SELECT {keys}, v FROM ({sql_ticks(samples, reach, step)})"
        f" QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY t DESC, v DESC) = 1"
    )


def sql_rate(samples: str, labels: tuple[str, ...], window: int, step: int = m.MINUTE) -> str:
    keys = ", ".join([*labels, "tick"])
    return f"""SELECT {keys}, inc * ((span + least(CASE WHEN head >= gap * 1.1 THEN gap / 2 ELSE head END,
          CASE WHEN inc > 0 AND fv >= 0 THEN span * (fv / inc) END) + CASE WHEN tail >= gap * 1.1 THEN gap / 2 ELSE tail END) / span) / {window / 1000.0} AS v
      FROM (SELECT *, span / (n - 1) AS gap, (ft - (tick - {window})) / 1000.0::DOUBLE AS head, (tick - lt) / 1000.0::DOUBLE AS tail, lv - fv + lost AS inc
        FROM (SELECT {keys}, count(*) AS n, min(t) AS ft, max(t) AS lt, (max(t) - min(t)) / 1000.0::DOUBLE AS span,
            first(v ORDER BY t, v) AS fv, last(v ORDER BY t, v) AS lv, sum(CASE WHEN v < pv THEN pv ELSE 0 END) AS lost
          FROM (SELECT *, lag(v) OVER (PARTITION BY {keys} ORDER BY t, v) AS pv FROM ({sql_ticks(samples, window, step)}))
          GROUP BY {keys}) WHERE n >= 2 AND lt > ft)"""


def sql_agg(vector: str, by: tuple[str, ...], how: str = "sum(v)") -> str:
    keys = ", ".join([*by, "tick"])
    return f"SELECT {keys}, {how} AS v FROM ({vector}) GROUP BY {keys}"


def sql_divide(left: str, right: str, on: tuple[str, ...], keep: tuple[str, ...]) -> str:
    condition = " AND ".join(f"a.{k} = b.{k}" for k in (*on, "tick"))
    columns = ", ".join(f"a.{k}" for k in (*keep, "tick"))
    return f"SELECT {columns}, a.v / b.v AS v FROM ({left}) a JOIN ({right}) b ON {condition} WHERE b.v <> 0"


def sql_value(vector: str, labels: tuple[str, ...]) -> str:
    keys = "".join(f"{k}, " for k in labels)
    return f"SELECT {keys}tick, round(v + {SHIFT}, {DIGITS}) AS value FROM ({vector})"


# --------------------------------------------------------------------------- evaluation

_GRID = {"step": 600_000, "lookback": HOUR, "chunk": 24 * HOUR}
_EVENTS = "SELECT user_id::VARCHAR AS user, epoch_us(ts) // 1000 AS t, value AS v FROM events WHERE event_type = '{}'"


def _sql_events(kind: str) -> str:
    return sql_instant(_EVENTS.format(kind), ("user",), HOUR, 600_000)


@query("metric_instant", sql_value(_sql_events("click"), ("user",)))
def metric_instant(t):
    return rounded(m.instant(event_samples(t), "click", ["user"], **_GRID).select("user", "tick", "value"))


@query("metric_sum", sql_value(sql_agg(_sql_events("view"), ()), ()))
def metric_sum(t):
    return rounded(m.sum_by(m.instant(event_samples(t), "view", **_GRID)))


@query(
    "metric_counts",
    f"SELECT tick, count(*)::DOUBLE AS series, count(DISTINCT user)::DOUBLE AS users FROM ({_sql_events('view')}) GROUP BY tick",
)
def metric_counts(t):
    vector = m.instant(event_samples(t), "view", ["user"], **_GRID)
    series = m.count_series(vector).withColumnRenamed("value", "series")
    users = m.count_groups(vector, ["user"]).withColumnRenamed("value", "users")
    return series.join(users, "tick")


@query(
    "metric_ratio",
    sql_value(
        sql_divide(
            sql_agg(sql_instant(_EVENTS.format("click"), ("user",), 24 * HOUR, HOUR), ("user",)),
            sql_agg(sql_instant(_EVENTS.format("view"), ("user",), 24 * HOUR, HOUR), ("user",)),
            ("user",),
            ("user",),
        ),
        ("user",),
    ),
)
def metric_ratio(t):
    grid = {"step": HOUR, "lookback": 24 * HOUR, "chunk": 96 * HOUR}
    left, right = (m.sum_by(m.instant(event_samples(t), kind, ["user"], **grid), ["user"]) for kind in ("click", "view"))
    return rounded(m.divide(left, right, ["user"]))


@query(
    "metric_one_minus",
    sql_value(
        f"""SELECT a.user, a.tick, 1 - a.v / b.v AS v FROM ({sql_instant(_EVENTS.format("click"), ("user",), 24 * HOUR, HOUR)}) a
        JOIN ({sql_instant(_EVENTS.format("view"), ("user",), 24 * HOUR, HOUR)}) b ON a.user = b.user AND a.tick = b.tick WHERE b.v <> 0""",
        ("user",),
    ),
)
def metric_one_minus(t):
    grid = {"step": HOUR, "lookback": 24 * HOUR, "chunk": 96 * HOUR}
    pairs = m.matched(event_samples(t), "click", "view", ["user"], 1 - F.try_divide("left", "right"), **grid)
    return rounded(pairs.where(F.col("value").isNotNull()).select("user", "tick", "value"))


_SHARDED = """SELECT user_id::VARCHAR AS user, CAST(event_id % 3 AS VARCHAR) AS shard, epoch_us(ts) // 1000 AS t,
    CASE WHEN {} THEN 'nan'::DOUBLE ELSE value END AS v FROM events WHERE event_type = 'click'"""


def _sharded(t, undefined: str) -> DataFrame:
    """Clicks as samples of three series per user, some of them undefined."""
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("shard"), (F.col("event_id") % 3).cast("string"))
    value = F.when(F.expr(undefined), F.lit(float("nan"))).otherwise(F.col("value"))
    return t.events.where("event_type = 'click'").select(F.lit("click").alias("metric"), labels.alias("labels"), "ts", value.alias("value"))


@query(
    "metric_two_level_avg",
    sql_value(sql_agg(sql_agg(sql_instant(_SHARDED.format("false"), ("user", "shard"), 24 * HOUR, HOUR), ("user",)), (), "avg(v)"), ()),
)
def metric_two_level_avg(t):
    grid = {"step": HOUR, "lookback": 24 * HOUR, "chunk": 96 * HOUR}
    inner = m.sum_by(m.instant(_sharded(t, "false"), "click", ["user", "shard"], **grid), ["user"])
    return rounded(m.avg_by(inner))


_NAN = "event_id % 5 = 0"


@query(
    "metric_nan",
    sql_value(
        "SELECT * FROM (" + sql_agg(sql_instant(_SHARDED.format(_NAN), ("user", "shard"), 24 * HOUR, HOUR), ("user",)) + ") WHERE NOT isnan(v)",
        ("user",),
    ),
)
def metric_nan(t):
    """An undefined newest sample makes the sum undefined, and undefined results are dropped."""
    grid = {"step": HOUR, "lookback": 24 * HOUR, "chunk": 96 * HOUR}
    found = m.sum_by(m.instant(_sharded(t, _NAN), "click", ["user", "shard"], **grid), ["user"])
    return rounded(found.where(~F.isnan("value")))


_COUNTER_SQL = """SELECT user_id::VARCHAR AS user, epoch_us(ts) // 1000 AS t,
    sum(value) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS v FROM events"""


@query("metric_rate", sql_value(sql_rate(_COUNTER_SQL, ("user",), 48 * HOUR, 6 * HOUR), ("user",)))
def metric_rate(t):
    """A counter per user that restarts every day, so most windows contain resets."""
    running = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    samples = t.events.select(
        F.lit("spent_total").alias("metric"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        "ts",
        F.sum("value").over(running).alias("value"),
    )
    rates = m.rate(samples, "spent_total", 48 * HOUR, ["user"], step=6 * HOUR, chunk=96 * HOUR)
    return rounded(rates.select("user", "tick", "value"))


@query(
    "metric_minute",
    """SELECT event_type, epoch_us(date_trunc('minute', ts)) // 1000 AS minute_ms, arg_max(value, (ts, value)) AS value
    FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2""",
)
def metric_minute(t):
    """Every fifth sample is undefined and leaves the minute's earlier value."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    found = m.minute_values(t.events.withColumn("value", value), ["event_type"])
    return found.select("event_type", F.unix_millis("minute").alias("minute_ms"), "value")


@query(
    "metric_upsert",
    """SELECT event_type AS category, epoch_us(date_trunc('minute', ts)) // 1000 AS minute_ms, user_id,
      CASE WHEN count(*) FILTER (value > 20) > 0 THEN max(value) FILTER (value > 20) ELSE max(value) END AS value
    FROM events GROUP BY 1, 2, 3""",
)
def metric_upsert(t):
    """Keyed upsert of metric rows: large values arrive later than small ones and replace them."""
    keys = ["category", "minute_ms", "user_id"]
    rows = t.events.select(
        F.col("event_type").alias("category"), F.unix_millis(F.date_trunc("minute", "ts")).alias("minute_ms"), "user_id", "value"
    )
    late = F.col("value") > 20
    early = merge.latest_per_key(rows.where(~late).withColumn("_at", F.col("value")), keys, ["_at"])
    fresh = merge.latest_per_key(rows.where(late).withColumn("_at", F.col("value")), keys, ["_at"])
    return merge.merge_partial(early.drop("_at"), fresh.drop("_at"), keys, ["value"])


# --------------------------------------------------------------------------- look-ups

_NODE_SQL = "(SELECT s_suppkey, s_name AS node FROM supplier UNION ALL SELECT s_suppkey, '10.0.0.' || s_suppkey FROM supplier)"


def _supplier_nodes(t):
    address = F.struct(
        F.lit("InternalIP").alias("type"), F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("address")
    )
    other = F.struct(F.lit("Hostname").alias("type"), F.lit("shared").alias("address"))
    return t.supplier.select(
        F.col("s_suppkey").cast("string").alias("uuid"), F.col("s_name").alias("name"), F.array(address, other).alias("addresses")
    )


@query(
    "metric_entity_join",
    f"""SELECT event_id, s_suppkey::VARCHAR AS node_uuid FROM events JOIN {_NODE_SQL} n
      ON n.node = CASE WHEN user_id % 2 = 0 THEN printf('Supplier#%09d', user_id) ELSE '10.0.0.' || user_id END""",
)
def metric_entity_join(t):
    user = F.col("user_id").cast("string")
    even = F.col("user_id") % 2 == 0
    rows = t.events.select(
        "event_id",
        F.when(even, F.format_string("Supplier#%09d", "user_id")).otherwise("").alias("node"),
        F.concat(F.lit("10.0.0."), user, F.lit(":9100")).alias("instance"),
    )
    looked_up = rows.withColumn("node", c.node_key())
    return looked_up.join(relate.node_names(_supplier_nodes(t)), "node").select("event_id", "node_uuid")


# --------------------------------------------------------------------------- the library


def _instant_of(metric: str, where: str = "TRUE") -> str:
    labels = SAMPLES[metric][0]
    return sql_instant(f"SELECT * FROM ({sql_metric(metric)}) WHERE {where}", labels)


def _sum_of(metric: str, by: tuple[str, ...], where: str = "TRUE") -> str:
    return sql_agg(_instant_of(metric, where), by)


def _rate_of(metric: str, minutes: int, by: tuple[str, ...], where: str = "TRUE", how: str = "sum(v)") -> str:
    labels = SAMPLES[metric][0]
    samples = f"SELECT * FROM ({sql_metric(metric)}) WHERE {where}"
    return sql_agg(sql_rate(samples, labels, minutes * m.MINUTE), by, how)


_BUSY = "mode NOT IN ('idle', 'iowait', 'steal')"
_PHYSICAL = "NOT regexp_full_match(device, '(veth|azv|lxc).*')"


def _pairs(left: str, right: str, value: str, labels: tuple[str, ...]) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in (*labels, "tick"))
    keys = ", ".join(f"a.{k}" for k in (*labels, "tick"))
    return f"SELECT {keys}, {value} AS v FROM ({_instant_of(left)}) a JOIN ({_instant_of(right)}) b ON {on}"


def _memory_sql(by: tuple[str, ...]) -> str:
    used = _pairs(c.MEMORY_TOTAL, c.MEMORY_FREE, "a.v - b.v", ("instance", "node"))
    return sql_divide(sql_agg(used, by), _sum_of(c.MEMORY_TOTAL, by), by, by)


def _allocation_sql(by: tuple[str, ...]) -> list[str]:
    found = []
    for resource, capacity in (("cpu", c.NODE_CORES), ("memory", c.NODE_MEMORY)):
        for source in (c.REQUESTS, c.LIMITS):
            amount = _sum_of(source, by, f"resource = '{resource}'")
            found += [amount, sql_divide(amount, _sum_of(capacity, ("node",)), ("node",), by)]
    return found


def _library() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Metric id -> (SQL of its vector, labels)."""
    pod, scraped = ("namespace", "pod"), ("instance", "namespace", "pod")
    node_allocations = _allocation_sql(("node",))
    found = {
        "C01": (sql_agg(_instant_of(c.NODE_INFO), (), "count(DISTINCT node)::DOUBLE"), ()),
        "C02": (sql_agg(_instant_of(c.NAMESPACE_CREATED), (), "count(*)::DOUBLE"), ()),
        "C07": (sql_agg(_rate_of(c.NODE_CPU, 1, ("instance", "cpu"), _BUSY), (), "avg(v)"), ()),
        "C08": (
            f"SELECT a.tick, a.v / b.v AS v FROM ({sql_agg(_pairs(c.MEMORY_TOTAL, c.MEMORY_FREE, 'a.v - b.v', ('instance', 'node')), ())}) a"
            f" JOIN ({_sum_of(c.MEMORY_TOTAL, ())}) b ON a.tick = b.tick",
            (),
        ),
        "C09": (_sum_of(c.POD_QOS, ("qos_class",)), ("qos_class",)),
        "C10": (_rate_of(c.RECEIVED, 2, (), _PHYSICAL), ()),
        "C11": (_rate_of(c.TRANSMITTED, 2, (), _PHYSICAL, "-sum(v)"), ()),
        "C12": (_rate_of(c.RECEIVED, 2, ("device",), _PHYSICAL), ("device",)),
        "N01": (sql_agg(_rate_of(c.NODE_CPU, 2, ("node", "cpu"), _BUSY), ("node",), "avg(v)"), ("node",)),
        "N06": (_memory_sql(("instance",)), ("instance",)),
        "N11": (_rate_of(c.RECEIVED, 2, ("node",)), ("node",)),
        "N12": (_rate_of(c.TRANSMITTED, 2, ("node",), how="-sum(v)"), ("node",)),
        "N13": (
            sql_agg(_pairs(c.DISK_FREE, c.DISK_SIZE, "1 - a.v / b.v", ("node", "mountpoint")), ("node", "mountpoint")),
            ("node", "mountpoint"),
        ),
        "P01": (_rate_of(c.CONTAINER_CPU, 2, scraped), scraped),
        "P02": (
            sql_divide(
                _sum_of(c.CONTAINER_MEMORY, scraped),
                f"SELECT node AS instance, tick, v FROM ({_sum_of(c.MEMORY_TOTAL, ('node',))})",
                ("instance",),
                scraped,
            ),
            scraped,
        ),
        "P03": (_rate_of(c.CONTAINER_CPU, 2, pod), pod),
        "P04": (_sum_of(c.CONTAINER_MEMORY, pod), pod),
    }
    for number, phase in enumerate(("Running", "Pending", "Failed", "Succeeded"), start=3):
        found[f"C{number:02d}"] = (_sum_of(c.POD_PHASE, (), f"phase = '{phase}'"), ())
    for number, sql in zip((2, 3, 4, 5, 7, 8, 9, 10), node_allocations):
        found[f"N{number:02d}"] = (sql, ("node",))
    by = ("node", *pod)
    for number, sql in enumerate(_allocation_sql(by), start=5):
        found[f"P{number:02d}"] = (sql, by)
    by = ("node", *pod, "container")
    for number, sql in enumerate(_allocation_sql(by), start=1):
        found[f"K{number:02d}"] = (sql, by)
    return found


LIBRARY = _library()


def _library_query(metric_id: str):
    labels = LIBRARY[metric_id][1]

    def run(t):
        entry = c.catalog()[metric_id]
        return rounded(c.vector(entry, metric_samples(t, entry.sources)).select(*labels, "tick", "value"))

    return run


for _id, (_sql, _labels) in sorted(LIBRARY.items(), key=lambda item: ("CNPK".index(item[0][0]), item[0])):
    query(f"metric_{_id.lower()}", sql_value(_sql, _labels))(_library_query(_id))


# --------------------------------------------------------------------------- metric tables

# Category and name label per metric id, as they are stored.
_STORED = {
    "N01": ("cpu.usage", ""),
    "N06": ("memory.usage", ""),
    "N11": ("network.received.bytes", ""),
    "N13": ("filesystem.usage", "mountpoint"),
    "P02": ("memory.usage", ""),
    "P06": ("cpu.request.percentage", ""),
    "K01": ("cpu.request", ""),
    "K08": ("memory.limit.percentage", ""),
    "C09": ("qos_by_class", "qos_class"),
    "C12": ("network.received.bytes.bydevice", "device"),
}


# The rest of the catalogue.
_ALL_STORED = {
    **_STORED,
    "C01": ("node.count", ""),
    "C02": ("namespace.count", ""),
    "C03": ("pod.running", ""),
    "C04": ("pod.pending", ""),
    "C05": ("pod.failed", ""),
    "C06": ("pod.succeeded", ""),
    "C07": ("cpu.usage", ""),
    "C08": ("memory.usage", ""),
    "C10": ("network.received.bytes", ""),
    "C11": ("network.transmitted.bytes", ""),
    "N12": ("network.transmitted.bytes", ""),
    "P01": ("cpu.usage", ""),
    "P03": ("cpu.usage.cores", ""),
    "P04": ("memory.usage.bytes", ""),
}
_ALLOCATED = [f"{r}.{k}{p}" for r in ("cpu", "memory") for k in ("request", "limit") for p in ("", ".percentage")]
for _prefix, _numbers in (("N", (2, 3, 4, 5, 7, 8, 9, 10)), ("P", range(5, 13)), ("K", range(1, 9))):
    _ALL_STORED.update({f"{_prefix}{n:02d}": (category, "") for n, category in zip(_numbers, _ALLOCATED)})


def _nodes_view(t):
    """Every second node number is known, half of them by name and half by address."""
    number = F.expr(EVENT_COLUMNS["node_no"])
    known = t.events.select(number.alias("n")).distinct().where(F.col("n") % 2 == 0)
    text = F.col("n").cast("string")
    address = F.struct(F.lit("InternalIP").alias("type"), F.concat(F.lit("10.0.0."), text).alias("address"))
    return known.select(
        F.concat(F.lit("uid-"), text).alias("uuid"), F.concat(F.lit("node-"), text).alias("name"), F.array(address).alias("addresses")
    )


def _pods_view(t):
    user = F.col("user_id").cast("string")
    return (
        t.events.where(F.col("user_id") % 3 != 0)
        .select(
            F.concat(F.lit("ns-"), (F.col("user_id") % 5).cast("string")).alias("namespace"),
            F.concat(F.lit("pod-"), user).alias("pod"),
            F.concat_ws("-", F.lpad(user, 8, "0"), *[F.lit("0000")] * 3, F.lit("000000000000")).alias("pod_uuid"),
        )
        .distinct()
    )


def _stored_sql(metric_id: str) -> str:
    vector, labels = LIBRARY[metric_id]
    category, name = _ALL_STORED[metric_id]
    named = name or "''"
    source = f"({vector})"
    if metric_id[0] == "C":
        entity = "'cluster-1'"
    elif metric_id[0] == "N":
        node = "node" if "node" in labels else "'node-' || regexp_extract(instance, '^10\\.0\\.0\\.([0-9]+):', 1)"
        number = f"CAST(replace({node}, 'node-', '') AS BIGINT)"
        source = f"(SELECT *, {number} AS n FROM {source}) WHERE n % 2 = 0"
        entity = "'uid-' || n"
    else:
        uid = "lpad(replace(pod, 'pod-', ''), 8, '0') || '-0000-0000-0000-000000000000'"
        source = f"{source} WHERE CAST(replace(pod, 'pod-', '') AS BIGINT) % 3 <> 0"
        entity = uid if metric_id[0] == "P" else sql_uuid5(uid, "container")
    return (
        f"SELECT entity_uuid, tick AS timestamp, category, name, round(max(v) + {SHIFT}, {DIGITS}) AS value FROM (SELECT {entity} AS entity_uuid, tick,"
        f" '{category}' AS category, {named} AS name, v FROM {source}) GROUP BY ALL"
    )


def _lookups(t, level: str) -> dict:
    return {
        c.CLUSTER: lambda: {"cluster": F.lit("cluster-1")},
        c.NODE: lambda: {"nodes": relate.node_names(_nodes_view(t))},
    }.get(level, lambda: {"pods": _pods_view(t)})()


def _level_query(level: str):
    """Every metric of the level, its sources evaluated once."""

    def run(t):
        sources = {source for e in c.catalog().values() if e.level == level for source in e.sources}
        return rounded(c.level_rows(level, metric_samples(t, tuple(sources)), **_lookups(t, level)))

    return run


def _stored_query(level: str):
    def run(t):
        entries = {i: e for i, e in c.catalog().items() if i in _STORED and e.level == level}
        samples = metric_samples(t, tuple(source for e in entries.values() for source in e.sources))
        parts = [c.metric_rows(entry, c.vector(entry, samples), **_lookups(t, level)) for entry in entries.values()]
        return rounded(reduce(DataFrame.unionByName, parts))

    return run


for _level, _letter in ((c.CLUSTER, "C"), (c.NODE, "N"), (c.POD, "P"), (c.CONTAINER, "K")):
    _some, _every = ([i for i in sorted(ids) if i[0] == _letter] for ids in (_STORED, _ALL_STORED))
    query(f"metric_rows_{_level}", " UNION ALL ".join(_stored_sql(i) for i in _some))(_stored_query(_level))
    query(f"metric_level_{_level}", " UNION ALL ".join(_stored_sql(i) for i in _every))(_level_query(_level))

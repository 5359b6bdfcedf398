"""Notification events and the rules that route them."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clusterlens.functions.state import severity, state_rank
from clusterlens.functions.text import nullable, text, url_path
from clusterlens.session import scratch_dir

# Fixed values.
ORPHAN_MESSAGE = "Automatically resolving the incident because of an orphaned resource."
RULE_VERSION = 1

# So many templates are evaluated in one job: it bounds the size of a plan, not the number of rules.
TEMPLATES_AT_ONCE = 64

# Rules at fault are looked for with so many events first, if there are more than a hundred times as many.
TRIED = 1_000

# A row of matches has at most so many words, of 64 cases each; a template of more cases has several rows.
WORDS = 8

# So many words of matches, and so many ids, are in the memory of a Python worker at once, or those of one event.
WORDS_AT_ONCE = 1 << 15
IDS_AT_ONCE = 1 << 17

# Arguments that stand for a value of the event.
EVENT_VALUES = {":uuid": "_event.uuid", ":cluster_uuid": "_event.cluster_uuid"}


def health_events(rows: DataFrame, kind: str) -> DataFrame:
    """One event per row of a table with a health state."""
    resource = F.lit(kind)
    return rows.select(
        "uuid",
        "cluster_uuid",
        resource.alias("kind"),
        F.concat("namespace", F.lit("/"), "name").alias("name"),
        severity(state_rank(F.col("health_state"))).alias("severity"),
        F.col("health_reason").alias("message"),
        url_path(resource, F.col("uuid")).alias("url"),
        F.create_map(
            F.lit("uuid"),
            F.col("uuid"),
            F.lit("cluster_uuid"),
            F.col("cluster_uuid"),
            F.lit("name"),
            F.col("name"),
            F.lit("namespace"),
            F.col("namespace"),
            F.lit("resource"),
            resource,
        ).alias("tags"),
    )


def orphan_events(orphaned: DataFrame) -> DataFrame:
    """Events that resolve the incidents of vanished objects.

    ``orphaned``: uuid, cluster_uuid, resource, name, namespace.
    """
    namespace, name = text(F.col("namespace")), text(F.col("name"))
    tags = {"uuid": F.col("uuid"), "resource": F.col("resource"), "name": name, "namespace": namespace}
    tagged = F.create_map(*[x for key, value in tags.items() for x in (F.lit(key), value)])
    cluster = nullable(F.col("cluster_uuid"))
    with_cluster = F.map_concat(tagged, F.create_map(F.lit("cluster_uuid"), cluster))
    return orphaned.select(
        "uuid",
        cluster.alias("cluster_uuid"),
        F.col("resource").alias("kind"),
        F.when(namespace == "", name).otherwise(F.concat(namespace, F.lit("/"), name)).alias("name"),
        F.lit("ok").alias("severity"),
        F.lit(ORPHAN_MESSAGE).alias("message"),
        url_path(F.col("resource"), F.col("uuid")).alias("url"),
        F.when(cluster.isNotNull(), with_cluster).otherwise(tagged).alias("tags"),
    )


def absolute_url(base: str) -> Column:
    """Event link below the address of the web interface."""
    return F.concat(F.lit(base.rstrip("/")), F.col("url"))


def event_json(events: DataFrame) -> DataFrame:
    """The event documents for a JSON or message-queue sink."""
    extra = F.col("extra_tags") if "extra_tags" in events.columns else F.lit(None).cast("map<string,string>")
    body = F.struct("name", "severity", "message", "url", "tags", extra.alias("extra_tags"))
    return events.select("uuid", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))


def changed_events(events: DataFrame, previous: DataFrame) -> DataFrame:
    """Events whose severity or message is not the one sent last for the object."""
    last = previous.select("uuid", "severity", "message")
    return events.join(last, ["uuid", "severity", "message"], "left_anti").select(events.columns)


# --------------------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """A routing rule; one made from an empty filter has no query and matches every event."""

    id: str
    kind: str | None = None
    query: str | None = None
    args: tuple[object, ...] = ()


def parse_rule(id_: str, filter_: str | None) -> Rule:
    """Decode one rule; raises ``ValueError`` if it cannot be used.

    Only an empty filter matches everything; any other needs a kind and a query.
    """
    if not filter_:
        return Rule(id_)
    body = json.loads(filter_)
    if not isinstance(body, dict):
        raise ValueError(f"rule {id_} is no JSON object")
    if body.get("version") != RULE_VERSION:
        raise ValueError(f"rule {id_} has version {body.get('version')}, {RULE_VERSION} expected")
    for field in ("kind", "query"):
        if not isinstance(body.get(field), str) or not body[field]:
            raise ValueError(f"rule {id_} has no {field}")
    args = body.get("args") or []
    if not isinstance(args, list):
        raise ValueError(f"rule {id_} has arguments that are no list")
    return Rule(id_, body["kind"], body["query"], tuple(args))


def load_rules(rules: DataFrame) -> tuple[list[Rule], dict[str, str]]:
    """Rules of a table (id, filter), by id, and why others are unusable."""
    usable, rejected = [], {}
    for row in rules.select("id", "filter").orderBy("id", "filter").toLocalIterator():
        try:
            usable.append(parse_rule(row["id"], row["filter"]))
        except ValueError as error:
            rejected[row["id"]] = str(error)
    return usable, rejected


def judged_rules(rules: DataFrame) -> DataFrame:
    """Rules of a table (id, filter) decoded in Spark: ``id, kind, query, args, types`` and ``reason``, why one is unusable.

    The conditions are those of :func:`parse_rule`.  ``args`` are texts and ``types`` what they are: ``string``, ``bigint``,
    ``double``, ``boolean``, ``void``, or the name of an event value.  A rule of an empty filter has no query.
    """
    body = F.try_parse_json("filter")
    shown = rules.select("id", "filter", body.alias("body")).withColumn("form", F.schema_of_variant("body"))

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get("body", f"$.{name}", kind)

    args = F.coalesce(field("args", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.schema_of_variant(field("args", "variant")).startswith("ARRAY") | F.coalesce(F.is_variant_null(field("args", "variant")), F.lit(True))

    def kind_of(value: Column) -> Column:
        name = F.schema_of_variant(value)
        text = F.try_variant_get(value, "$", "string")
        return (
            F.when((name == "STRING") & text.isin(*EVENT_VALUES), text)
            .when(name == "STRING", "string")
            .when(name.startswith("DECIMAL") | (name == "DOUBLE"), "double")
            .otherwise(F.lower(name))
        )

    empty = F.coalesce(F.col("filter"), F.lit("")) == ""
    version = field("version", "string")
    reason = (
        F.when(empty, None)
        .when(F.col("body").isNull(), "its filter is no JSON")
        .when(~F.col("form").startswith("OBJECT"), "it is no JSON object")
        .when(~F.coalesce(version == str(RULE_VERSION), F.lit(False)), F.concat(F.lit(f"version {RULE_VERSION} expected, not "), F.coalesce(version, F.lit("none"))))
        .when(F.coalesce(field("kind", "string"), F.lit("")) == "", "it has no kind")
        .when(F.coalesce(field("query", "string"), F.lit("")) == "", "it has no query")
        .when(~listed, "its arguments are no list")
    )
    return shown.select(
        "id",
        F.when(~empty, field("kind", "string")).alias("kind"),
        F.when(~empty, field("query", "string")).alias("query"),
        F.transform(args, lambda v: F.try_variant_get(v, "$", "string")).alias("args"),
        F.transform(args, kind_of).alias("types"),
        reason.alias("reason"),
    )


def _bound(query: str, types: Iterable[str]) -> str:
    """The query with its ``?`` bound to the event or to the columns of the rule's parameters."""
    remaining = iter(enumerate(types))

    def bind(found: re.Match) -> str:
        if found.group() != "?":
            return found.group()  # quoted text
        number, kind = next(remaining)  # StopIteration: an argument is missing
        return EVENT_VALUES.get(kind, "NULL" if kind == "void" else f"_rule.p{number}")

    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|\?", bind, query)


@dataclass(frozen=True)
class Template:
    """What rules share that differ in the values of their arguments only."""

    number: int
    kind: str
    query: str
    types: tuple[str, ...]

    def bound(self) -> tuple[str, ...]:
        """The columns of an event that the query is bound to."""
        return tuple(value.removeprefix("_event.") for key, value in EVENT_VALUES.items() if key in self.types)

    def matches(self, events: str, places: str, rules: DataFrame, first: int, width: int) -> DataFrame:
        """``template, kind, uuid, cluster_uuid, word, words``: which of the rules' cases match, by what the query is bound to.

        Bit ``n % 64`` of the word ``n / 64`` stands for the case of the number ``n``; ``words`` are the ``width`` words from ``word`` on, and
        ``first`` is the word of the template's lowest number.  Words are aggregated in place, so neither time nor memory is
        spent on a set per object.  A query that is not bound to the uuid is evaluated per cluster (``places``), not per event.  An
        inner lateral join lets the optimiser begin with the tables the query names and join the parameters last.
        """
        own = rules.where(F.col("template") == self.number)
        values = [
            F.col("args")[k].cast(kind).alias(f"p{k}") for k, kind in enumerate(self.types) if kind not in EVENT_VALUES and kind != "void"
        ]
        view = f"_rules_{os.urandom(8).hex()}"
        place = F.expr(f"shiftright(number, 6) - {first}")
        bits = [F.when(place % width == k, F.expr("shiftleft(1L, number % 64)")).otherwise(F.lit(0).cast("bigint")).alias(f"b{k}") for k in range(width)]
        own.select((place - place % width + first).alias("word"), *bits, *values).createOrReplaceTempView(view)
        query, keys = _bound(self.query, self.types), self.bound()
        spark = rules.sparkSession
        try:
            found = spark.sql(
                f"SELECT {''.join(f'_event.{k}, ' for k in keys)}_rule.word, array({', '.join(f'bit_or(_rule.b{k})' for k in range(width))}) AS words"
                f" FROM {events if 'uuid' in keys else places} AS _event JOIN {view} AS _rule,"
                f" LATERAL ({query}) WHERE _event.kind = :_kind GROUP BY {', '.join([*[f'_event.{k}' for k in keys], '_rule.word'])}",
                args={"_kind": self.kind},
            )
        finally:
            spark.catalog.dropTempView(view)
        rest = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("uuid", "cluster_uuid")]
        return found.select(F.lit(self.number).alias("template"), F.lit(self.kind).alias("kind"), *rest, "word", "words")


def _at_fault(error: Exception) -> bool:
    """Whether the query is to blame: Spark names the condition, or an argument is missing.

    A lost cluster is no fault of a rule; that error is raised.
    """
    return isinstance(error, StopIteration) or isinstance(error, PySparkException) and bool(error.getCondition())


def _reason(error: Exception) -> str:
    return str(error).splitlines()[0] if str(error) else type(error).__name__


def _id_lists(named: pa.Table, always: pa.Table, then: Callable[[pa.ListArray], pa.Array] | None) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The function of an Arrow UDF that makes the sorted ids out of the matches of an event, a list of ``word, words``.

    ``named`` are the ids of each case, by number, ``always`` those of rules without a query.  Every id has a rank; the ranks of an event's
    cases are sorted as numbers, together for many events, and stand for the ids in a dictionary array.  It needs no import of this
    library.
    """
    listed, others = named.column("ids").combine_chunks(), always.column("id").combine_chunks()
    known = pa.concat_arrays([listed.flatten(), others]).unique()
    known = known.take(pc.sort_indices(known))
    ranks = pc.index_in(listed.flatten(), known).to_numpy()
    lengths = pc.list_value_length(listed).to_numpy().astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    everywhere = pc.index_in(others, known).to_numpy().astype(np.int64)
    size = len(known)
    words_at_once, ids_at_once = WORDS_AT_ONCE, IDS_AT_ONCE

    def parts(weights: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows that weigh at most ``limit``, or are one row."""
        ends, low = np.cumsum(weights), 0
        while low < len(ends):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield low, high
            low = high

    def lists(events: int, owner: np.ndarray, case: np.ndarray) -> pa.ListArray:
        kind = np.int32 if events * size < 1 << 31 else np.int64
        count = lengths[case]
        ends = np.cumsum(count)
        at = np.repeat((starts[case] - (ends - count)).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        key = np.repeat((owner * size).astype(kind), count)
        key += ranks[at]
        if len(everywhere):
            key = np.concatenate([key, (np.arange(events)[:, None] * size + everywhere).ravel().astype(kind)])
        if events * size <= 16 * len(key):
            marked = np.zeros(events * size, bool)
            marked[key] = True
            key = np.flatnonzero(marked)
        else:
            key.sort()
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        ends = np.searchsorted(key, (np.arange(events + 1) * size).astype(np.int64))
        code = (key - np.repeat((np.arange(events) * size).astype(key.dtype), np.diff(ends))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.DictionaryArray.from_arrays(code, known))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            word, words = batch.flatten().flatten()
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(batch).to_numpy().astype(np.int64))])
            within = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy().astype(np.int64))])
            word, words = word.to_numpy(), words.flatten().to_numpy()
            for low, high in parts(within[bounds[1:]] - within[bounds[:-1]], words_at_once):
                rows = slice(bounds[low], bounds[high])
                width = np.diff(within[bounds[low] : bounds[high] + 1])
                owner = np.repeat(np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1])), width)
                first, last = within[bounds[low]], within[bounds[high]]
                place = np.repeat(word[rows] - within[:-1][rows], width) + np.arange(first, last)
                bits = np.unpackbits(words[first:last].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, bit = np.nonzero(bits)
                owner, case = owner[which], place[which] * 64 + bit
                weights = np.bincount(owner, lengths[case], high - low).astype(np.int64) + len(everywhere)
                for a, b in parts(weights, ids_at_once):
                    pairs = slice(*np.searchsorted(owner, [a, b]))
                    ids = lists(b - a, owner[pairs] - a, case[pairs])
                    yield then(ids) if then else pa.ListArray.from_arrays(ids.offsets, ids.values.dictionary_decode())

    return run


def match_rule_table(
    events: DataFrame, rules: DataFrame, tables: dict[str, DataFrame], then: tuple[Callable[[pa.ListArray], pa.Array], str] | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """Add ``rule_ids``, the sorted ids of the rules that match each event; ``rules`` are those of :func:`judged_rules`.

    ``then``, a function and the type of what it returns, is applied to the lists of ids where they are made, some events at a time, and
    ``rule_ids`` is what it makes of them.  Their values are an Arrow dictionary array: each different id is there as text once.

    A rule's query matches an event if it returns a row with the event's identifiers bound.  Rules of the same query,
    kind and types of arguments form a *template*: their arguments are a table that is joined once, however many they
    are; the driver sees the distinct templates, and the ids, which every task of the last step has.  Rules of a template that are given
    the same arguments are one *case* of it; matches are bits of words until the ids take their place in the last step, in
    Python.  ``tables`` are the tables queries may name.

    The events' identifiers and the cases are written to the shared folder once.  Several templates are evaluated in one
    job; each job appends its matches there, and all matches are aggregated once.  If a job fails, be it in analysis
    or at run time, its templates are evaluated one by one, and the cases of one that fails are halved until those
    at fault are alone; their rules are left out and reported.  With very many events, a few of them are tried first in the same way, for
    queries bound to the uuid: a rule that fails for most objects is then found without joining all events again and again.
    """
    spark = events.sparkSession
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    folder = scratch_dir(spark, "rules")
    events.select("uuid", "cluster_uuid", "kind").write.parquet(f"{folder}/events")
    view, places = f"_events_{os.urandom(8).hex()}", f"_places_{os.urandom(8).hex()}"
    known = spark.read.schema("uuid string, cluster_uuid string, kind string").parquet(f"{folder}/events")
    known.createOrReplaceTempView(view)
    known.select("cluster_uuid", "kind").distinct().write.parquet(f"{folder}/places")
    spark.read.schema("cluster_uuid string, kind string").parquet(f"{folder}/places").createOrReplaceTempView(places)
    hits = f"{folder}/hits"
    usable = rules.where(F.col("reason").isNull())
    found = usable.where(F.col("query").isNotNull()).select("kind", "query", "types").distinct().collect()
    templates = [Template(k, r.kind, r.query, tuple(r.types)) for k, r in enumerate(sorted(found, key=lambda r: (r.kind, r.query, r.types)))]
    schema = "template int, kind string, query string, types array<string>"
    numbered = spark.createDataFrame([(t.number, t.kind, t.query, list(t.types)) for t in templates], schema)
    cases = usable.join(numbered, ["kind", "query", "types"]).groupBy("template", "args").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    # One row, as large as the rule_ids of an event that all rules match; the numbers have no gaps.
    listed = cases.agg(F.sort_array(F.collect_list(F.struct("template", "args", "ids"))).alias("cases"))
    listed.select(F.posexplode("cases").alias("number", "case")).select("number", "case.*").write.parquet(f"{folder}/rules")
    stored = spark.read.schema("number int, template int, args array<string>, ids array<string>").parquet(f"{folder}/rules")
    spans = {r.template: range(r.low, r.high + 1) for r in stored.groupBy("template").agg(F.min("number").alias("low"), F.max("number").alias("high")).collect()}
    templates = [t for t in templates if t.number in spans]
    rejected: dict[str, str] = {}
    faulty: list[int] = []
    written = False

    def sound() -> DataFrame:
        return stored.where(~F.col("number").isin(faulty)) if faulty else stored

    def found_by(group: list[Template], own: DataFrame, source: str) -> DataFrame:
        width = min(WORDS, max(1 + (spans[t.number][-1] >> 6) - (spans[t.number][0] >> 6) for t in group))
        return reduce(DataFrame.unionByName, [t.matches(source, places, own, spans[t.number][0] >> 6, width) for t in group])

    def evaluate(name: str, group: list[Template], own: DataFrame) -> None:
        nonlocal written
        # Written again, a part replaces what a failed attempt has left.
        found_by(group, own, view).write.mode("overwrite").parquet(f"{hits}/part={name}")
        written = True

    def attempt(name: str, group: list[Template], own: DataFrame) -> None:
        found_by(group, own, few).write.format("noop").mode("overwrite").save()

    def halved(action: Callable, template: Template, depth: int, part: int) -> None:
        own = sound().where((F.col("template") == template.number) & (F.pmod(F.xxhash64("number"), F.lit(1 << depth)) == part))
        try:
            action(f"{template.number}-{depth}-{part}", [template], own)
        except Exception as error:
            if not _at_fault(error):
                raise
            some = own.select("number", "ids").limit(2).collect()
            if len(some) < 2 or depth == 62:
                rejected.update({id_: _reason(error) for r in some for id_ in r.ids})
                faulty.extend(r.number for r in some)
                return
            halved(action, template, depth + 1, part)
            halved(action, template, depth + 1, part + (1 << depth))

    def in_groups(action: Callable, some: list[Template]) -> None:
        for low in range(0, len(some), TEMPLATES_AT_ONCE):
            group = some[low : low + TEMPLATES_AT_ONCE]
            try:
                action(f"group-{low}", group, sound())
            except Exception as group_error:
                if not _at_fault(group_error):
                    raise
                for template in group:
                    halved(action, template, 0, 0)

    if known.count() > 100 * TRIED:
        few = f"_few_{os.urandom(8).hex()}"
        known.limit(TRIED).write.parquet(f"{folder}/few")
        spark.read.schema(known.schema).parquet(f"{folder}/few").createOrReplaceTempView(few)
        in_groups(attempt, [t for t in templates if "uuid" in t.bound()])
        spark.catalog.dropTempView(few)
        templates = [t for t in templates if not set(spans[t.number]) <= set(faulty)]
    in_groups(evaluate, templates)
    spark.catalog.dropTempView(view)
    spark.catalog.dropTempView(places)
    schema = "template INT, kind STRING, uuid STRING, cluster_uuid STRING, word INT, words ARRAY<BIGINT>"
    matches = spark.read.schema(schema).parquet(hits) if written else spark.createDataFrame([], schema)
    by_uuid = matches.where(F.col("template").isin([t.number for t in templates if "uuid" in t.bound()])).select("uuid", "kind", "word", "words")
    parts = [by_uuid]
    for keys in ((), ("cluster_uuid",)):
        numbers = [t.number for t in templates if t.bound() == keys]
        if numbers:
            here = matches.where(F.col("template").isin(numbers)).select(F.col("kind").alias("_kind"), F.col("cluster_uuid").alias("_cluster"), "word", "words")
            same = [F.col("kind") == F.col("_kind"), *[F.col(k).eqNullSafe(F.col("_cluster")) for k in keys]]
            parts.append(known.join(here, same).select("uuid", "kind", "word", "words"))
    # Words of bits per object, so it is bounded by the number of cases.
    by_event = reduce(DataFrame.unionByName, parts).groupBy("uuid", "kind").agg(F.collect_list(F.struct("word", "words")).alias("_words"))
    # Words are few bytes for what they become: a given number of partitions is not merged by their size.
    spread = events.join(by_event, ["uuid", "kind"], "left").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = stored.select("number", "ids").orderBy("number").toArrow()
    always = usable.where(F.col("query").isNull() & F.col("id").isNotNull()).select("id").distinct().toArrow()
    function, kind = then or (None, "array<string>")
    listed = F.arrow_udf(_id_lists(named, always, function), kind)
    words = F.coalesce("_words", F.array().cast("array<struct<word: int, words: array<bigint>>>"))
    return spread.withColumn("rule_ids", listed(words)).select(*events.columns, "rule_ids"), rejected


def _type(value: object) -> str:
    if isinstance(value, str):
        return value if value in EVENT_VALUES else "string"
    return {bool: "boolean", int: "bigint", float: "double", type(None): "void"}.get(type(value), "string")


def match_rules(
    spark: SparkSession, events: DataFrame, rules: Iterable[Rule], tables: dict[str, DataFrame]
) -> tuple[DataFrame, dict[str, str]]:
    """:func:`match_rule_table` for rules that are already parsed."""
    rows = [
        (r.id, r.kind, r.query, [None if a is None else json.dumps(a) if not isinstance(a, str) else a for a in r.args], [_type(a) for a in r.args], None)
        for r in rules
    ]
    schema = "id string, kind string, query string, args array<string>, types array<string>, reason string"
    return match_rule_table(events, spark.createDataFrame(rows, schema), tables)

"""Streaming jobs.

Each one is a ``foreachBatch`` around operators that are the same in batch.  Sinks are keyed
tables whose batches can be written again, so a batch retried after a lost executor or driver
leaves the same tables.  Tables are the state; no state lives only in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from clusterlens.functions.ids import ensure_uuid
from clusterlens.operators import logs, merge, notify, relate
from clusterlens.plans import sync
from clusterlens.sources.readers import parse_objects
from clusterlens.sources.tables import SEQ, KeyedTable, sized

Consumer = Callable[[DataFrame, int], None]
Clock = Callable[[], Column]


def object_changes(
    changes: DataFrame,
    store: sync.Store,
    kind: str,
    *,
    clock: Clock = F.current_timestamp,
    replace_children: bool = False,
    ignore_deletes: bool = False,
    tombstones: KeyedTable | None = None,
    stateful: bool = False,
    on_upsert: Sequence[Consumer] = (),
    on_delete: Sequence[Consumer] = (),
) -> DataStreamWriter:
    """Apply a stream of change records to the tables of a kind.

    Per batch the last change of each object counts.  Consumers run in order after the write
    and get the rows written, or the keys deleted.  ``ignore_deletes`` is for kinds that are
    only ever added to (events).  With ``tombstones``, a table of deleted keys, a delete counts
    once until the object is back.  ``stateful`` says that the stream has an operator with state:
    each batch is then written to a staging folder first.  All stages of a plan that starts at the
    state, also those after a shuffle or a cache, would send its metrics with every task.

    The sequence number of each change goes into all tables, so that streams with unrelated
    batches, and changes that arrive late, leave the same rows in any order.
    """

    def apply(batch: DataFrame, number: int) -> None:
        mine = batch.where(F.col("kind") == kind)
        with sync.staged(store, mine, kind, number) if stateful else nullcontext(mine) as known:
            change(known.withColumn("change_uuid", ensure_uuid(F.col("uid"))), number)

    def change(mine: DataFrame, number: int) -> None:
        last = sync.coalesced(mine.withColumnRenamed("object", "raw")).persist()
        try:
            now = clock()
            if not ignore_deletes:
                gone = last.where("deleted").select(F.col("change_uuid").alias("uuid"), F.col("seq").alias(SEQ))
                if tombstones is not None:
                    gone = first_deletes(gone, number, tombstones, kind)
                store.delete(kind, gone, number)
                for consumer in on_delete:
                    consumer(gone, number)
            fresh = last.where(~sync.is_delete()).select("raw", "cluster_uuid", F.col("seq").alias(SEQ))
            objects = sync.guarded(parse_objects(fresh, kind), now).withColumnRenamed("cluster_uuid", "source_cluster")
            rows = store.upsert(
                kind, objects, F.col("source_cluster"), now, number, replace_children=replace_children
            )
            if tombstones is not None:
                reappeared(rows, number, tombstones, kind)
            for consumer in on_upsert:
                consumer(rows, number)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(apply)


def metric_minutes(samples: DataFrame, table: KeyedTable, keys: Sequence[str]) -> DataStreamWriter:
    """Last value per key and minute; later samples of a minute replace what is stored.

    ``table`` is keyed by ``keys`` and ``minute`` and keeps the time of its value in ``ts``.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fresh = (
            batch.where(~F.isnan("value"))
            .groupBy(*keys, F.date_trunc("minute", "ts").alias("minute"))
            .agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "value")).alias("last"))
            .select(*keys, "minute", "last.ts", "last.value")
        )
        minutes = [*keys, "minute"]
        # Only stored rows of the minutes at hand can be older or newer than a fresh one.
        stored = table.read(number, only=fresh)
        table.upsert(merge.merge_latest(stored, fresh, minutes, ["ts", "value"]), number)

    return samples.writeStream.foreachBatch(apply)


def minute_windows(samples: DataFrame, keys: Sequence[str], late: str = "5 minutes") -> DataFrame:
    """The same as a windowed streaming aggregation with bounded lateness, for append sinks."""
    windowed = samples.where(~F.isnan("value")).withWatermark("ts", late)
    return (
        windowed.groupBy(*keys, F.window("ts", "1 minute").alias("w"))
        .agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
        .select(*keys, F.col("w.start").alias("minute"), "value")
    )


def log_appends(chunks: DataFrame, table: KeyedTable, containers: Callable[[], DataFrame]) -> DataStreamWriter:
    """Append log chunks to the stored tails of started containers."""

    def apply(batch: DataFrame, number: int) -> None:
        fresh = logs.wanted_chunks(batch, containers()).persist()
        try:
            _append(fresh, table, number)
        finally:
            fresh.unpersist()

    return chunks.writeStream.foreachBatch(apply)


def log_file_appends(lines: DataFrame, table: KeyedTable, containers: Callable[[], DataFrame]) -> DataStreamWriter:
    """The same from the lines of log files of any size (``read_log_lines``)."""

    def apply(batch: DataFrame, number: int) -> None:
        _append(logs.line_chunks(batch, containers()), table, number)

    return lines.writeStream.foreachBatch(apply)


def _append(fresh: DataFrame, table: KeyedTable, number: int) -> None:
    # Positions in a log are no change numbers: any delete of the container comes after them.
    table.upsert(logs.append_logs(table.read(number, only=fresh, writer="logs"), fresh), number, "logs", 0)


def service_pods(store: sync.Store, services: Callable[[], DataFrame], pods: Callable[[], DataFrame]) -> tuple[Consumer, Consumer, Consumer]:
    """Consumers that keep ``service_pod``: after pod upserts, service upserts and pod deletes.

    ``services`` and ``pods`` read the other side anew for each batch.
    """
    table = store.tables["service_pod"]

    def on_pods(rows: DataFrame, number: int) -> None:
        changed = sized(rows.select(F.col("uuid").alias("pod_uuid"), SEQ))
        mine = pods().join(changed, "pod_uuid", "left_semi")
        table.upsert(relate.select_pods(services(), mine).join(changed, "pod_uuid"), number, "pods")

    def on_services(rows: DataFrame, number: int) -> None:
        changed = sized(rows.select(F.col("uuid").alias("service_uuid"), SEQ))
        mine = services().join(changed, "service_uuid", "left_semi")
        table.upsert(relate.select_pods(mine, pods()).join(changed, "service_uuid"), number, "services")

    def on_pod_deletes(gone: DataFrame, number: int) -> None:
        keys = sized(gone.select(F.col("uuid").alias("pod_uuid"), SEQ))
        table.delete(table.keys_of(keys, "pod_uuid", number, "pods"), number, "pods")

    return on_pods, on_services, on_pod_deletes


def health_notifications(
    kind: str,
    sink: Consumer,
    *,
    rules: Callable[[], DataFrame] | None = None,
    tables: Callable[[], dict[str, DataFrame]] = dict,
    sent: KeyedTable | None = None,
    on_rejected: Callable[[dict[str, str]], None] | None = None,
) -> Consumer:
    """Consumer of upserted rows that routes their health events to a sink.

    Every upsert makes an event, changed or not; with ``sent``, a table of the events sent
    last, only changed ones do.  Rules are read once per batch; ``on_rejected`` gets the ids of
    those that cannot be used, each with the reason.
    """

    def consume(rows: DataFrame, number: int) -> None:
        events = notify.health_events(rows, kind)
        if sent is not None:
            events = notify.changed_events(events, sent.read(number, only=events, writer=kind))
        if rules is not None:
            judged = notify.judged_rules(rules())
            events, failed = notify.match_rule_table(events, judged, tables())
            if on_rejected is not None:
                unusable = {r.id: r.reason for r in judged.where("reason IS NOT NULL").select("id", "reason").toLocalIterator()}
                if unusable or failed:
                    on_rejected({**unusable, **failed})
        events = events.persist()
        try:
            sink(events, number)
            if sent is not None:
                sent.upsert(events.select("uuid", "severity", "message"), number, kind)
        finally:
            events.unpersist()

    return consume


def json_sink(folder: str, writer: str = "main") -> Consumer:
    """Event documents as JSON lines, one folder per batch of a writer."""

    def write(events: DataFrame, number: int) -> None:
        notify.event_json(events).select("value").write.mode("overwrite").text(f"{folder}/writer={writer}/batch={number}")

    return write


def first_deletes(gone: DataFrame, number: int, tombstones: KeyedTable, writer: str = "main") -> DataFrame:
    """Keys deleted now that were not deleted before; they count as deleted until they re-appear."""
    known = tombstones.read(number, only=gone, writer=writer)
    fresh = merge.delete_keys(gone.dropDuplicates(["uuid"]), known, "uuid")
    tombstones.upsert(fresh, number, writer)
    return tombstones.batch(number, writer)


def reappeared(rows: DataFrame, number: int, tombstones: KeyedTable, writer: str = "main") -> None:
    """Forget the deletes of objects that are back, including one of the same change."""
    back = rows.withColumn(SEQ, F.col(SEQ) + 1) if SEQ in rows.columns else rows
    tombstones.delete(back, number, f"{writer}-back")

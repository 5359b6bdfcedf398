"""Common frame of the two operators that find repeated passages across all documents.

A *window* is a fixed number of consecutive units (bytes or words).  Each operator assigns every window
a key that depends on the window's content alone, so equal windows have equal keys, wherever they
stand.  Consecutive windows of one key form a *run*.  Then, in one chain of Spark stages:

1. every scan task sends each distinct key once to the key's shard;
2. shards tell the blocks of documents which keys occur in two documents or more;
3. blocks of documents send the runs of those keys, with their content, to the key's shard, each
   distinct run once;
4. shards compare the runs, exactly by the operator's method, and tell blocks which windows repeat;
5. blocks make the result of their documents.

A key or passage that a third of all documents share thus reaches a shard once per scan task and once
per block, not once per document.  What moves is packed into byte strings, one per sender and
receiver.  Blocks hold about ``BLOCK`` bytes of text, and their number follows the input.

Documents are ordered by id, those of a null id last; rows of one id are ordered by their text.  Documents are
dealt to blocks by id.  The rows of an id that many share (``null`` included) are dealt by a hash of their
text as well, so that no id fills a block by itself; only equal texts of one id stay together.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import text as tx
from clusterlens.llm.staging import column

BLOCK = 4 << 20
SHARD_BLOCKS = 8
FLUSH = 8 << 20
LAST = np.iinfo(np.int64).max
ROW_BYTES = 64  # what a row counts for beside its text
PLACE = 40  # bits of a place in a block; above them, for documents of a shared id, stands the start of the text's hash
MOVED = "part int, kind int, body binary"
_MOVED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
KEYS, TEXTS, FLAGS, RUNS = 0, 1, 2, 3


@dataclass
class Runs:
    """Runs of windows: ``keys[i]`` holds for the windows that start at ``low[i] .. high[i] - 1``."""

    keys: np.ndarray
    low: np.ndarray
    high: np.ndarray
    content: np.ndarray  # hash of all units that the run's windows cover; runs of one hash are compared byte by byte
    before: np.ndarray  # units before each text
    more: tuple = ()  # what the operator needs again


@dataclass
class Method:
    """What an operator brings: how to find runs, what bytes of them to send, and how to compare these."""

    runs: Callable[[np.ndarray, np.ndarray], Runs]
    content: Callable[[np.ndarray, Runs, np.ndarray], tuple[np.ndarray, np.ndarray]]
    compare: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]
    later: Callable[[np.ndarray, np.ndarray], np.ndarray]  # of a run's document and the first one's: does the run repeat it?
    # Which runs may hold a window twice; None: windows of one document do not repeat each other.
    inner: Callable[[np.ndarray, np.ndarray, Runs, np.ndarray], np.ndarray] | None = None


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpack(body: bytes, *types: type) -> list[np.ndarray]:
    count = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, count, 8)
    at, out = 8 * (count + 1), []
    for size, kind in zip(sizes.tolist(), types):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def by_part(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the positions that belong to it."""
    if not len(parts):
        return
    order = np.argsort(parts, kind="stable")
    cut = np.flatnonzero(np.diff(parts[order])) + 1
    for own in np.split(order, cut):
        yield int(parts[own[0]]), own


def united(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same positions as intervals that neither overlap nor touch."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    return low[first], high[np.append(first[1:], len(low)) - 1]


def alike(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Which pairs of slices (start and count in ``values``) are equal, compared in portions of about ``limit``."""
    equal = counts[first] == counts[second]
    todo = np.flatnonzero(equal)
    upto = np.cumsum(counts[first[todo]])
    low = 0
    while low < len(todo):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + limit, side="right")))
        own = todo[low:high]
        sizes = counts[first[own]]
        same = values[tx.spread(starts[first[own]], sizes)] == values[tx.spread(starts[second[own]], sizes)]
        wrong = np.flatnonzero(~same)
        equal[own[np.searchsorted(np.cumsum(sizes), wrong, side="right")]] = False
        low = high
    return equal


def repeats_first(method: Method, order: np.ndarray, new: np.ndarray, docs: np.ndarray, values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which of the runs in ``order`` repeat the first run of their key and hash (``new``) as a whole."""
    heads = order[new][np.cumsum(new) - 1]
    found = method.later(docs[order], docs[heads]) & ~new
    found[found] = alike(values, starts, counts, order[found], heads[found])
    return found


def moved(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, body = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], schema=_MOVED)


def lean() -> None:
    """Let Arrow return freed memory to the system, since many workers share a machine."""
    pa.set_memory_pool(pa.system_memory_pool())


def document_keys(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def text_tags(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A hash of each text."""
    found = [tx.Hashes(tx.VALUES[part]).of(cut[:-1], cut[1:]) for _, _, part, cut in tx.pieces(texts)]
    return np.concatenate([*found, np.zeros(0, np.uint64)])


def block_of(ids: pa.Array, texts: pa.Array, blocks: int, shared: np.ndarray) -> np.ndarray:
    """The block of each document; those of the ids in ``shared`` are spread by their texts."""
    keys = document_keys(ids)
    mixed = tx.mix(keys.view(np.uint64))
    own = np.flatnonzero(np.isin(keys, shared))
    if len(own):
        mixed[own] = tx.mix(mixed[own] ^ text_tags(texts.take(pa.array(own))))
    return (mixed % np.uint64(blocks)).astype(np.int64)


def _ask(method: Method, blocks: int, shards: int, shared: np.ndarray):
    """Stage 1. Part 0 .. shards - 1: a shard; shards + b: block b."""

    def flush(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[int, int, bytes]]:
        keys, docs, parts = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((docs, keys))
        keys, docs, parts = keys[order], docs[order], parts[order]
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        new = new_key | np.concatenate([[True], docs[1:] != docs[:-1]])
        keys, parts, new_key = keys[new], parts[new], new_key[new]
        heads = np.flatnonzero(new_key)
        many = np.diff(np.append(heads, len(keys))) > 1
        rows = []
        # Repeated within this task: its blocks are told at once.
        of_many = np.repeat(many, np.diff(np.append(heads, len(keys))))
        for part, own in by_part(parts[of_many]):
            rows.append((shards + part, KEYS, pack(np.unique(keys[of_many][own]))))
        keys, parts = keys[heads], parts[heads]
        for part, own in by_part((keys % np.uint64(shards)).astype(np.int64)):
            rows.append((part, KEYS, pack(keys[own], parts[own].astype(np.int32), many[own])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        found, size, docs, sources = [], 0, 0, 0
        for batch in batches:
            parts = block_of(batch.column(0), batch.column(1), blocks, shared)
            for first, last, data, offsets in tx.pieces(batch.column(1)):
                runs = method.runs(data, offsets)
                doc = np.searchsorted(runs.before, runs.low, side="right") - 1
                keys, source, part = runs.keys, docs + doc, parts[first:last][doc]
                docs += last - first
                if method.inner:  # every run is a source of its own, and one that may hold a window twice is two
                    twice = np.flatnonzero(method.inner(data, offsets, runs, np.arange(len(keys))))
                    keys, part = np.concatenate([keys, keys[twice]]), np.concatenate([part, part[twice]])
                    source = np.arange(len(keys)) + sources
                    sources += len(keys)
                found.append((keys, source, part))
                size += len(data)
                if size >= FLUSH:
                    yield moved(flush(found))
                    found, size = [], 0
        if found:
            yield moved(flush(found))

    return run


def _answer(shards: int):
    """Stage 2: which keys of a shard come from two tasks or from two documents of one task."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= shards:
            return pa.Table.from_batches([moved([(part - shards, KEYS, x.as_py()) for x in table.column("body")])])
        keys, blocks, many = (np.concatenate(x) for x in zip(*[unpack(x.as_py(), np.uint64, np.int32, bool) for x in table.column("body")]))
        order = np.argsort(keys, kind="stable")
        keys, blocks, many = keys[order], blocks[order], many[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        again = np.repeat((sizes > 1) | np.logical_or.reduceat(many, heads), sizes) & ~many
        keys, blocks = keys[again], blocks[again]
        return pa.Table.from_batches([moved([(b, KEYS, pack(keys[own])) for b, own in by_part(blocks)])])

    return run


def _texts(blocks: int, shared: np.ndarray):
    """The documents, packed by block."""
    def flush(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        table = pa.Table.from_batches(batches)
        parts = block_of(table.column(0).combine_chunks(), table.column(1), blocks, shared)
        rows = []
        for part, own in by_part(parts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table.take(pa.array(own)).combine_chunks())
            rows.append((part, TEXTS, sink.getvalue().to_pybytes()))
        return moved(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size = [], 0
        for batch in batches:
            rest = batch.columns[2:]
            batch = pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.large_string()), *rest], names=["id", "text", *map(str, range(len(rest)))]
            )
            step = max(1, batch.num_rows // 16)  # what is held stays near FLUSH bytes
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                held.append(part)
                size += part.nbytes
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


class Block:
    """The documents of a block in order, their texts joined, and what else was sent to the block."""

    def __init__(self, table: pa.Table) -> None:
        lean()
        kinds, bodies = table.column("kind").to_pylist(), table.column("body")
        self.sent = defaultdict(list)
        texts = []
        for i, kind in enumerate(kinds):
            if kind == TEXTS:
                texts.append(pa.ipc.open_stream(bodies[i].as_py()).read_all())
            else:
                self.sent[kind].append(bodies[i].as_py())
        documents = pa.concat_tables(texts)
        keys = document_keys(documents.column(0).combine_chunks())
        column = documents.column(1).combine_chunks()
        whole = list(tx.pieces(column, 1 << 62))
        data, offsets = (whole[0][2], whole[0][3]) if whole else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        tag = text_tags(column)
        # Equal texts of one id are alike in any order.
        order = np.lexsort((tag, keys))
        self.ids = documents.column(0).combine_chunks().take(pa.array(order))
        self.rest = documents.select(range(2, documents.num_columns)).take(pa.array(order))
        self.null = column.is_null().take(pa.array(order))
        self.keys = keys[order]
        self.tags = tag[order]
        sizes = np.diff(offsets)[order]
        self.data = data[tx.spread(offsets[:-1][order], sizes)]
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])

    def pieces(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        low, n = 0, len(self.keys)
        while low < n:
            high = int(np.searchsorted(self.offsets, self.offsets[low] + tx.PIECE, side="right")) - 1
            high = min(max(high, low + 1), n)
            yield low, high, self.data[self.offsets[low] : self.offsets[high]], self.offsets[low : high + 1] - self.offsets[low]
            low = high


def _send(method: Method, shards: int, shared: np.ndarray):
    """Stage 3: the runs of repeated keys, each distinct one once per block; others are judged here."""

    def run(table: pa.Table) -> pa.Table:
        block_id, block = table.column("part")[0].as_py(), Block(table)
        if not block.sent[KEYS]:
            return pa.Table.from_batches([moved([])])
        wanted = np.unique(np.concatenate([unpack(x, np.uint64)[0] for x in block.sent[KEYS]]))
        base, found = 0, []
        for first, last, data, offsets in block.pieces():
            runs = method.runs(data, offsets)
            at = np.minimum(np.searchsorted(wanted, runs.keys), len(wanted) - 1)
            own = np.flatnonzero(wanted[at] == runs.keys)
            doc = np.searchsorted(runs.before, runs.low[own], side="right") - 1
            values, counts = method.content(data, runs, own)
            inner = method.inner(data, offsets, runs, own) if method.inner else np.zeros(len(own), bool)
            at, sizes = base + runs.low[own], runs.high[own] - runs.low[own]
            # Places of documents of one id in different blocks are compared by their texts' hashes first.
            above = (block.tags[first:last][doc] >> np.uint64(PLACE + 1)).astype(np.int64) << PLACE
            found.append((runs.keys[own], runs.content[own], block.keys[first:last][doc], at, above, sizes, inner, values, counts))
            base += int(runs.before[-1])
        keys, content, docs, at, above, sizes, inner, values, counts = (np.concatenate(x) for x in zip(*found))
        if not len(keys):
            return pa.Table.from_batches([moved([])])
        order = np.lexsort((at, docs, content, keys))
        k, c = keys[order], content[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        starts = np.cumsum(counts) - counts
        later = repeats_first(method, order, new, docs, values, starts, counts)
        flagged, stay = order[later], order[~later]
        rows = [(shards + block_id, FLAGS, pack(*united(at[flagged], at[flagged] + sizes[flagged])))] if len(flagged) else []
        for part, own in by_part((keys[stay] % np.uint64(shards)).astype(np.int64)):
            own = stay[own]
            spread = np.isin(docs[own], shared)
            place = at[own] + np.where(spread, above[own], 0)
            body = np.frombuffer(pa.compress(values[tx.spread(starts[own], counts[own])].tobytes(), codec="zstd", asbytes=True), np.uint8)
            head = (np.array([block_id], np.int64), keys[own], content[own], docs[own], place)
            rows.append((part, RUNS, pack(*head, sizes[own].astype(np.int32), counts[own].astype(np.int32), inner[own], body)))
        return pa.Table.from_batches([moved(rows)])

    return run


def _judge(method: Method, shards: int):
    """Stage 4: windows of a shard that repeat, by block."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part >= shards:
            return pa.Table.from_batches([moved([(part - shards, FLAGS, x.as_py()) for x in table.column("body")])])
        types = (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32, bool, np.uint8)
        parts = [unpack(x.as_py(), *types) for x in table.column("body")]
        for x in parts:
            x[-1] = np.frombuffer(pa.decompress(x[-1].tobytes(), int(x[6].sum()), codec="zstd", asbytes=True), np.uint8)
        blocks = np.concatenate([np.repeat(x[0], len(x[1])) for x in parts])
        keys, content, docs, at, sizes, counts, inner, values = (np.concatenate(x) for x in list(zip(*parts))[1:])
        sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
        flags: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Equal runs: those after the first repeat as a whole, and the first stands for them.
        order = np.lexsort((at, docs, content, keys))
        k, c = keys[order], content[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        starts = np.cumsum(counts) - counts
        after = repeats_first(method, order, new, docs, values, starts, counts)
        later, stay = order[after], order[~after]
        flags.append((blocks[later], at[later], at[later] + sizes[later]))
        # Keys with several runs left: their windows are compared.
        k = keys[stay]
        alone = np.concatenate([[True], k[1:] != k[:-1]]) & np.concatenate([k[1:] != k[:-1], [True]])
        rest = stay[~alone | inner[stay]]
        for own in _portions(keys[rest], counts[rest]):
            own = rest[own]
            i, low, high = method.compare(keys[own], docs[own], at[own], sizes[own], values, starts[own], counts[own])
            flags.append((blocks[own[i]], low, high))
        block, low, high = (np.concatenate(x) for x in zip(*flags))
        width = high - low
        low = low & ((1 << PLACE) - 1)
        high = low + width
        return pa.Table.from_batches([moved([(b, FLAGS, pack(*united(low[own], high[own]))) for b, own in by_part(block)])])

    return run


def _portions(keys: np.ndarray, counts: np.ndarray, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """Positions, cut between keys into portions of about ``limit`` bytes; one key is never divided."""
    low, ends = 0, np.flatnonzero(np.concatenate([keys[1:] != keys[:-1], [True]])) + 1 if len(keys) else []
    size = np.cumsum(counts)
    for end in np.asarray(ends, np.int64).tolist():
        if size[end - 1] - (size[low - 1] if low else 0) >= limit or end == len(keys):
            yield np.arange(low, end)
            low = end


def repeated(documents: DataFrame, method: Method, finish: Callable[[Block, np.ndarray, np.ndarray], pa.Table], schema: str, doc_id: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """``finish(block, low, high)`` for every block of documents, with the repeated windows ``low .. high - 1``.

    Positions count units from the start of the block.  The columns ``carry`` are in its ``rest``, in order.
    """
    rows = documents.select(column(doc_id).cast("bigint").alias("id"), column(text).cast("string").alias("text"))
    by_id = rows.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("times"))
    heavy = (F.col("times") > 1) & (F.coalesce("size", F.lit(0)) + ROW_BYTES * F.col("times") > BLOCK)
    # Fewer ids than blocks can be this heavy.
    size, found = by_id.agg(F.sum("size"), F.collect_list(F.when(heavy, F.struct("id")))).first()
    size, shared = size or 0, np.array([LAST if row["id"] is None else row["id"] for row in found], np.int64)
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-size // BLOCK), min(partitions, -(-size // tx.PIECE)))
    shards = max(1, -(-blocks // SHARD_BLOCKS), min(partitions, blocks))
    texts = rows.mapInArrow(tx.frugal(_texts(blocks, shared)), MOVED)
    asked = rows.mapInArrow(tx.frugal(_ask(method, blocks, shards, shared)), MOVED)
    answers = asked.groupBy("part").applyInArrow(tx.frugal(_answer(shards)), MOVED)
    sent = texts.unionByName(answers).groupBy("part").applyInArrow(tx.frugal(_send(method, shards, shared)), MOVED)
    flags = sent.groupBy("part").applyInArrow(tx.frugal(_judge(method, shards)), MOVED)

    def end(table: pa.Table) -> pa.Table:
        block = Block(table)
        found = [unpack(x, np.int64, np.int64) for x in block.sent[FLAGS]]
        low, high = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return finish(block, low, high)

    if carry:
        carried = [column(c).alias(f"c{i}") for i, c in enumerate(carry)]
        whole = documents.select(column(doc_id).cast("bigint").alias("id"), column(text).cast("string").alias("text"), *carried)
        texts = whole.mapInArrow(tx.frugal(_texts(blocks, shared)), MOVED)
    return texts.unionByName(flags).groupBy("part").applyInArrow(tx.frugal(end), schema)

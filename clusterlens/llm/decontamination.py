"""Benchmark decontamination: broadcast windows of benchmark words, scanned over all documents.

The windows of the benchmark items are hashed and broadcast.  Each document's word windows are
looked up by hash, every hit is verified on the words themselves, and the words that hits cover
are reported (:func:`scan`) or removed (:func:`clean`).

The size of the broadcast is proven first: a benchmark of more than ``limit`` bytes of text is
divided into blocks of at most about that size, and the documents are scanned once per block.

Defined cases: a null text has no words; a null item id marks words but is not listed; repeated
documents and items are handled as they come; an empty benchmark hits nothing; only the id and text
columns are read by :func:`scan`, and :func:`clean` passes all others through unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import text as tx
from clusterlens.llm.staging import free_name, stage

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

class Windows:
    """The word windows of some benchmark items, by their number of words."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        texts: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = WORD.findall((text or "").encode().lower())
            n = min(size, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                texts[n][b" ".join(words[i : i + n])].update([] if item is None else [item])
        self.by_size = {}
        for n, found in texts.items():
            by_hash = defaultdict(list)
            for window, owners in found.items():
                by_hash[self._hash(window)].append((window, sorted(owners)))
            hashes = np.array(sorted(by_hash), np.uint64)
            known = np.zeros(1 << 20, bool)
            known[hashes >> np.uint64(44)] = True
            self.by_size[n] = (hashes, known, [by_hash[int(h)] for h in hashes])

    @staticmethod
    def _hash(window: bytes) -> int:
        data = np.frombuffer(window, np.uint8)
        starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.ALPHANUMERIC)
        return int(tx.Hashes(tx.Hashes(tx.VALUES[data]).of(starts, ends)).fixed(len(starts))[0])

    def hits(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """First word, number of words and item ids of each verified hit."""
        if not self.by_size or not len(starts):
            return
        hashes = tx.Hashes(tx.Hashes(tx.VALUES[low]).of(starts, ends))
        flat, flat_ends = tx.joined(low, starts, ends)
        flat_starts = flat_ends - (ends - starts)
        for n, (known, bits, windows) in self.by_size.items():
            own = hashes.fixed(n)
            inside = tx.window_starts(before, n)[: len(own)]
            maybe = np.flatnonzero(inside & bits[own >> np.uint64(44)])
            at = np.minimum(np.searchsorted(known, own[maybe]), len(known) - 1)
            equal = known[at] == own[maybe]
            for i, k in zip(maybe[equal].tolist(), at[equal].tolist()):
                words = flat[flat_starts[i] : flat_ends[i + n - 1]].tobytes()
                for window, items in windows[k]:
                    if window == words:
                        yield i, n, items


def _scanner(index):
    def scan_piece(data: np.ndarray, offsets: np.ndarray):
        low = tx.LOWER[data]
        starts, ends, before = tx.words(low, offsets, tx.ALPHANUMERIC)
        found = list(index.value.hits(low, starts, ends, before))
        at = np.array([i for i, _, _ in found], np.int64)
        end = at + np.array([n for _, n, _ in found], np.int64)
        items: dict[int, set[str]] = defaultdict(set)
        for doc, (_, _, owners) in zip((np.searchsorted(before, at, side="right") - 1).tolist(), found):
            items[doc].update(owners)
        return starts, ends, before, at, end, items

    return scan_piece


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _pass(index, text: str, hits_name: str, items_name: str):
    """Add one block's hits to the columns of hits and of items."""
    scan_piece = _scanner(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            hits, items = batch.column(names.index(hits_name)).to_pylist(), batch.column(names.index(items_name)).to_pylist()
            for first, last, data, offsets in tx.pieces(batch.column(names.index(text))):
                starts, _, before, at, end, own = scan_piece(data, offsets)
                mask = tx.covered(len(starts), at, end)
                for doc in np.unique(np.searchsorted(before, at, side="right") - 1).tolist():
                    local = mask[before[doc] : before[doc + 1]].copy()
                    for a, b in zip(hits[first + doc][::2], hits[first + doc][1::2]):
                        local[a:b] = True
                    hits[first + doc] = np.stack(_runs(local), axis=1).ravel().tolist()
                    items[first + doc] = sorted(set(items[first + doc]) | own[doc])
            columns = list(batch.columns)
            columns[names.index(hits_name)] = pa.array(hits, pa.list_(pa.int64()))
            columns[names.index(items_name)] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in lists of at most about ``limit`` bytes of text (one item may have more)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // limit)
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(row.item, row.text) for row in part.toLocalIterator()]


def _through(
    documents: DataFrame, benchmark: DataFrame, finish: Callable, schema: T.StructType, *, size: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = 8 << 20
) -> DataFrame:
    """``finish(batches, hits, items)`` over the documents with two more columns, whose free names it gets.

    They hold the hits (word intervals, flat) and the sorted item ids.  The last block's hits are found in the same pass.
    """
    spark = documents.sparkSession
    hits, found_items = (free_name(name, documents.columns) for name in ("_hits", "_items"))
    state = documents.withColumns({hits: F.array().cast("array<bigint>"), found_items: F.array().cast("array<string>")})
    last = None
    for items in _blocks(benchmark, item_id, item_text, limit):
        if last is not None:
            state = stage(state.mapInArrow(tx.frugal(last), state.schema), "decontamination")
        last = _pass(spark.sparkContext.broadcast(Windows(items, size)), text, hits, found_items)
    find = last or (lambda batches: batches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from finish(find(batches), hits, found_items)

    return state.mapInArrow(tx.frugal(run), schema)


def scan(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: its id, ``n_words``, ``n_hit``, ``items`` (ids, sorted as strings) and ``spans``.

    ``spans`` are the hit stretches as numbers of words: first, and last plus one.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
            T.StructField("spans", T.ArrayType(T.LongType())),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch], *added: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hits, items = (batch.column(batch.schema.names.index(c)) for c in ("doc_id", "text", *added))
            for first, last, data, offsets in tx.pieces(texts):
                _, _, before = tx.words(tx.LOWER[data], offsets, tx.ALPHANUMERIC)
                own = hits.slice(first, last - first)
                n_hit = [sum(x[1::2]) - sum(x[::2]) for x in own.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(np.diff(before)), pa.array(n_hit, pa.int64()), items.slice(first, last - first), own],
                    names=schema.names,
                )

    return _through(rows, benchmark, count, schema, text="text", **options).withColumn(
        "spans", F.expr("transform(filter(spans, (x, i) -> i % 2 = 0), (x, i) -> struct(x AS start, spans[2 * i + 1] AS end))")
    )


def clean(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", drop_share: float = 0.5, **options) -> DataFrame:
    """The documents, all their columns, without the words that hits cover.

    A document of which hits cover more than ``drop_share`` of the words goes as a whole.  From a
    hit stretch the bytes from its first word up to its last word's end are removed; all other
    documents stay as they are, byte for byte.
    """
    schema = documents.schema

    def cut(batches: Iterator[pa.RecordBatch], hits_name: str, _: str) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index(text)
            texts, hits = batch.column(at), batch.column(names.index(hits_name)).to_pylist()
            touched = {i for i, x in enumerate(hits) if x}
            new, keep = {}, np.ones(batch.num_rows, bool)
            for i in touched:
                raw = texts[i].as_py().encode()
                data = tx.LOWER[np.frombuffer(raw, np.uint8)]
                starts, ends, _ = tx.words(data, np.array([0, len(data)]), tx.ALPHANUMERIC)
                gone = sum(b - a for a, b in zip(hits[i][::2], hits[i][1::2]))
                keep[i] = gone <= drop_share * len(starts)
                out, last = [], 0
                for a, b in zip(hits[i][::2], hits[i][1::2]):
                    out.append(raw[last : starts[a]])
                    last = ends[b - 1]
                new[i] = b"".join([*out, raw[last:]]).decode()
            columns = [batch.column(names.index(name)) for name in schema.names]
            if touched:
                kept = texts.to_pylist()
                columns[schema.names.index(text)] = pa.array([new.get(i, t) for i, t in enumerate(kept)], texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep))

    return _through(documents, benchmark, cut, schema, text=text, **options)

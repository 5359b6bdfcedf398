"""Substring deduplication by recompression of word sequences.

Every text is a sequence of words, each named by a hash.  A round of recompression names maximal runs of
one symbol by (symbol, length), then splits all symbols into two sides and names every left-right pair.
Names are functions of what they stand for, so they are global: all tasks give equal sequences equal names
without exchanging a dictionary.  Away from its ends, a repeated passage is parsed alike wherever it stands.

With each symbol goes the stretch of words that its parse depends on.  A symbol is *interior* to a window
if that stretch lies in the window; whether it is depends on the window alone.  The key of a
window is its interior symbol of the highest level, with its stretch's hash.
Equal windows share their key; shared keys reveal the candidates, and the windows below them are
verified word by word on their bytes, so a collision of names removes nothing.

A word is removed if a window of ``width`` words that covers it also starts in a document with a smaller id.

Defined cases: a null text has no words; documents of a null id come last; rows of one id are never earlier
than each other, so repeated rows stay alike; texts of fewer than ``width`` words lose nothing;
other columns are not read, or passed through by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import text as tx
from clusterlens.llm.repeats import Block, Method, Runs, repeated
from clusterlens.llm.staging import free_name

ROUNDS = 3
SHARED = 5
FAR = 1 << 40


class Level:
    """The symbols of a level: name, words ``start .. end - 1``, and the words ``low .. high - 1`` its parse depends on."""

    def __init__(self, name, start, end, low, high, doc) -> None:
        self.name, self.start, self.end, self.low, self.high, self.doc = name, start, end, low, high, doc

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What the symbol before begins to depend on, and where the one after ends to; far away at a text's edge."""
        inner = self.doc[1:] == self.doc[:-1]
        left = np.concatenate([[-FAR], np.where(inner, self.low[:-1], -FAR)])
        right = np.concatenate([np.where(inner, self.high[1:], FAR), [FAR]])
        return left, right

    def runs(self) -> Level:
        """Maximal runs of one symbol become one; their length depends on both neighbours."""
        left, right = self._neighbours()
        first = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])]))
        last = np.append(first[1:], len(self.name)) - 1
        count = (last - first + 1).astype(np.uint64)
        name = np.where(count > 1, tx.mix(self.name[first] + count * np.uint64(0xC2B2AE3D27D4EB4F)), self.name[first])
        return Level(name, self.start[first], self.end[last], left[first], right[last], self.doc[first])

    def pairs(self, salt: int) -> Level:
        """Each symbol of the left side joins a following one of the right side."""
        left, right = self._neighbours()
        side = (tx.mix(self.name ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(side), bool)
        joins[:-1] = ~side[:-1] & side[1:] & (self.doc[1:] == self.doc[:-1])
        tail = np.zeros(len(side), bool)
        tail[1:] = joins[:-1]
        own = np.flatnonzero(~tail)
        pair = joins[own]
        after = np.minimum(own + 1, len(side) - 1)
        name = np.where(pair, tx.mix(self.name[own] * np.uint64(0x9FB21C651E98DF25) + tx.mix(self.name[after])), self.name[own])
        # A pair depends on its halves alone; a left symbol alone on the one after it, a right one on the one before.
        low = np.where(side[own], left[own], self.low[own])
        high = np.where(pair, self.high[after], np.where(side[own], self.high[own], right[own]))
        return Level(name, self.start[own], np.where(pair, self.end[after], self.end[own]), low, high, self.doc[own])


def levels(names: np.ndarray, before: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    at = np.arange(len(names))
    found = [Level(names, at, at + 1, at, at + 1, np.repeat(np.arange(len(before) - 1), np.diff(before)))]
    for r in range(1, rounds + 1):
        found.append(found[-1].runs().pairs(r * 0x5851F42D4C957F2D & (1 << 64) - 1))
    return found


def window_keys(names: np.ndarray, before: np.ndarray, width: int) -> np.ndarray:
    """A key for every position; it counts only where a window starts."""
    hashes = tx.Hashes(names)
    keys = np.zeros(len(names), np.uint64)
    open_ = tx.window_starts(before, width)
    found = levels(names, before)
    # First the symbols that at least ``SHARED`` windows have in their interior, so that runs of one key are long.
    for most in (max(width - SHARED + 1, 1), width):
        for number in range(len(found) - 1, -1, -1):
            if not open_.any():
                return keys
            level = found[number]
            own = np.flatnonzero((level.high - level.low <= most) & (level.low >= 0) & (level.high <= len(names)))
            if number == 0 and most < width:
                continue
            low, high = level.low[own], level.high[own]
            size = high - low
            value = tx.mix(hashes.of(low, high) + level.name[own] * np.uint64(2 * number + 1) + (level.start[own] - low).astype(np.uint64)) | np.uint64(1)
            best = np.zeros(len(names), np.uint64)
            for back in range(width):
                fits = (size + back <= width) & (low >= back)
                np.maximum.at(best, low[fits] - back, value[fits])
            taken = open_ & (best > 0)
            keys[taken] = best[taken]
            open_ &= ~taken
    return keys


def same_windows(tokens: list[bytes], width: int) -> np.ndarray:
    """A number for the ``width`` words from each position on; equal numbers mean equal words.

    Words are numbered by a dictionary, and stretches of doubled length by their pairs of numbers.
    Past the end there is one more word, which equals no other.
    """
    known: dict[bytes, int] = {}
    power = np.array([known.setdefault(t, len(known) + 1) for t in tokens], np.int64)

    def joined(left: np.ndarray, right: np.ndarray, ahead: int) -> np.ndarray:
        after = np.zeros(len(right), np.int64)
        after[: max(len(right) - ahead, 0)] = right[ahead:]
        return np.unique(left * (after.max(initial=0) + 1) + after, return_inverse=True)[1] + 1

    found, size, step = None, 0, 1
    while True:
        if width & step:
            found = power if found is None else joined(found, power, size)
            size += step
        if size == width:
            return found
        power = joined(power, power, step)
        step *= 2


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, before = tx.words(data, offsets, tx.NOT_SPACE)
    return tx.Hashes(tx.VALUES[data]).of(starts, ends), starts, ends, before


def method(width: int) -> Method:
    def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
        names, starts, ends, before = _names(data, offsets)
        keys = window_keys(names, before, width)
        valid = tx.window_starts(before, width)
        first = valid.copy()
        first[1:] &= ~(valid[:-1] & (keys[1:] == keys[:-1]))
        starts_doc = np.zeros(len(valid), bool)
        starts_doc[before[:-1][before[:-1] < len(valid)]] = True
        first |= valid & starts_doc
        low = np.flatnonzero(first)
        stop = np.flatnonzero(np.concatenate([first | ~valid, [True]]))
        high = stop[np.searchsorted(stop, low, side="right")]
        return Runs(tx.mix(keys[low]), low, high, tx.Hashes(names ^ np.uint64(0xA5A5A5A5A5A5A5A5)).of(low, high + width - 1), before, (starts, ends))

    def content(data: np.ndarray, runs: Runs, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each run, each followed by one space."""
        (starts, ends), low, n_words = runs.more, runs.low[own], runs.high[own] - runs.low[own] + width - 1
        word = tx.spread(low, n_words)
        sizes = ends[word] - starts[word] + 1
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n_words)]
        return tx.joined(data, starts[word], ends[word])[0], np.diff(upto, prepend=0)

    def compare(keys, docs, at, sizes, values, starts, counts):
        n_words = sizes + width - 1
        run, place = np.repeat(np.arange(len(keys)), sizes), tx.spread(at, sizes)
        same = same_windows(values[tx.spread(starts, counts)].tobytes().split(b" ")[:-1], width)
        window = same[tx.spread(np.cumsum(n_words) - n_words, sizes)]
        order = np.lexsort((docs[run], window))
        run, window, place = run[order], window[order], place[order]
        new = np.concatenate([[True], window[1:] != window[:-1]])
        least = docs[run][new][np.cumsum(new) - 1]
        again = docs[run] > least
        return run[again], place[again], place[again] + 1

    return Method(runs, content, compare, lambda doc, first: doc > first)


def _marked(block: Block, low: np.ndarray, high: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the block with their words and which of them repeat."""
    counts, parts = 0, []
    for first, last, data, offsets in block.pieces():
        starts, ends, before = tx.words(data, offsets, tx.NOT_SPACE)
        parts.append((first, last, data, starts, ends, before, counts))
        counts += len(starts)
    gone = tx.covered(counts, low, high + width - 1)
    for first, last, data, starts, ends, before, base in parts:
        yield first, last, data, starts, ends, before, gone[base : base + len(starts)]


def removals(documents: DataFrame, *, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``spans`` (word intervals removed)."""

    def finish(block: Block, low: np.ndarray, high: np.ndarray) -> pa.Table:
        n_words, n_removed, digests, spans = [], [], [], []
        for first, last, data, starts, ends, before, gone in _marked(block, low, high, width):
            out, stops = tx.joined(data, starts[~gone], ends[~gone])
            kept = np.concatenate([[0], np.cumsum(~gone)])[before]
            n_words.append(np.diff(before))
            n_removed.append(np.diff(before) - np.diff(kept))
            for d, (a, b) in enumerate(zip(kept[:-1].tolist(), kept[1:].tolist())):
                digests.append(hashlib.sha256(out[(stops[a - 1] + 1 if a else 0) : stops[b - 1]] if b > a else b"").hexdigest())
                edge = np.diff(np.concatenate([[0], gone[before[d] : before[d + 1]].astype(np.int8), [0]])) if n_removed[-1][d] else np.zeros(0)
                spans.append([{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": block.ids,
                "n_words": pa.array(np.concatenate(n_words), pa.int64()),
                "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
                "kept_sha256": digests,
                "spans": pa.array(spans, span),
            }
        )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<start bigint, end bigint>>"
    return repeated(documents, method(width), finish, schema, doc_id, text)


def deduplicate(documents: DataFrame, *, width: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, with repeated words cut out of the text.

    A removed stretch takes its bytes from its first word up to the next kept word (or the text's end).  Texts
    without repeats stay as they are.  A text that is nothing but a repeat becomes empty.
    """
    names = documents.columns

    def finish(block: Block, low: np.ndarray, high: np.ndarray) -> pa.Table:
        keep = np.ones(len(block.data), bool)
        for first, last, data, starts, ends, before, gone in _marked(block, low, high, width):
            base = int(block.offsets[first])
            # A word goes with what follows it, up to the next word or the end of its text.
            stops = np.append(starts[1:], len(data))
            filled = before[:-1] < before[1:]
            stops[before[1:][filled] - 1] = (block.offsets[first + 1 : last + 1] - base)[filled]
            at = np.flatnonzero(gone)
            keep[base + tx.spread(starts[at], stops[at] - starts[at])] = False
        sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[block.offsets])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(block.data[keep].tobytes()))
        texts = pc.if_else(block.null, pa.scalar(None, pa.large_string()), texts).cast(pa.string())
        return pa.table([texts if name == text else column for name, column in zip(names, block.rest.columns)], names=names)

    # The text travels once; its place among the carried columns is held by a null.
    place = free_name("place_of_the_text", names)
    carried = documents.withColumn(place, F.lit(None).cast("boolean"))
    return repeated(carried, method(width), finish, documents.schema, doc_id, text, [place if name == text else name for name in names])

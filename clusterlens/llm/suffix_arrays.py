"""Suffix-array deduplication of repeated byte strings.

A byte is removed if a string of ``width`` bytes that covers it also starts earlier: in a document with a
smaller id, or further ahead in the same document.

Windows of ``width`` bytes are dealt to shards by content: the key of a window is the smallest hash among
the ``gram``-byte strings in it, so equal windows always meet in one shard and shards need not be compared
pair by pair.  A shard joins the stretches of text sent to it, sorts all their suffixes to a
depth of at least ``width`` bytes by Larsson-Sadakane refinement (first by eight bytes, then doubling, only
the groups that are still open), computes common prefixes by Kasai's recurrence in parallel strips,
and so finds the groups of equal windows.  A key whose stretches exceed a portion is sorted in several
suffix arrays, which are merged by binary search of each one's windows in the others.

Defined cases: a null text has no bytes; documents of a null id come last; rows of one id count as
one document, in the order of their texts, so a repeated row loses what its twin holds; shorter texts
lose nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clusterlens.llm import text as tx
from clusterlens.llm.repeats import Block, Method, Runs, repeated

PORTION = 1 << 20  # bytes in a suffix array, about
STRIP = 128


class Bytes:
    """Text with the eight bytes from each position as one big-endian number."""

    def __init__(self, data: np.ndarray) -> None:
        self.size = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((self.size + 1,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)

    def at(self, positions: np.ndarray) -> np.ndarray:
        return self.eight[np.minimum(positions, self.size)]


def suffix_array(text: Bytes, depth: int) -> np.ndarray:
    """Suffix starts, sorted by at least their first ``depth`` bytes (a suffix that ends is the smaller)."""
    n = text.size
    eight = text.eight[:n]
    # Only the last seven suffixes are padded; among equal numbers the shorter suffix is the smaller.
    left = np.minimum(n - np.arange(n), 8)
    order = np.argsort(eight, kind="stable")
    tail = np.isin(eight[order], eight[max(0, n - 7) :])
    if tail.any():
        own = order[tail]
        order[tail] = own[np.lexsort((left[own], eight[own]))]
    new = np.concatenate([[True], (eight[order][1:] != eight[order][:-1]) | (left[order][1:] != left[order][:-1])])
    head = np.flatnonzero(new)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(head, np.diff(np.append(head, n))) + 1
    rank[n] = 0
    h = 8
    while h < depth:
        grouped = rank[order]
        open_ = np.zeros(n, bool)
        equal = grouped[1:] == grouped[:-1]
        open_[1:] |= equal
        open_[:-1] |= equal
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        group, key = grouped[at], rank[np.minimum(own + h, n)]
        by = np.argsort(group * (n + 1) + key, kind="stable")
        own, group, key = own[by], group[by], key[by]
        order[at] = own
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        heads = np.flatnonzero(fresh)
        rank[own] = np.repeat(at[heads], np.diff(np.append(heads, len(at)))) + 1
        h *= 2
    return order


def common_prefixes(text: Bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place in the suffix array, the bytes shared with the suffix before it, up to ``limit``.

    The array must be sorted to that depth at least.

    Kasai's recurrence along the text (a suffix shares at least one byte less than its left neighbour did),
    run over many strips of the text at once.
    """
    n = text.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, STRIP)
    now, last = np.zeros(len(lanes), np.int64), np.full(len(lanes), -2)
    for step in range(min(STRIP, n)):
        at = lanes + step
        if at[-1] >= n:
            at, lanes, now, last = at[:-1], lanes[:-1], now[:-1], last[:-1]
        other = before[at]
        # The recurrence needs the exact order of the two, which holds for prefixes below the limit, or the same
        # pair one byte further.
        now = np.where((other >= 0) & ((now < limit) | (other == last + 1)), np.maximum(now - 1, 0), 0)
        last = other
        most = np.minimum(limit, n - np.maximum(at, other))
        active = np.flatnonzero((other >= 0) & (now < most))
        while len(active):
            x = text.at(at[active] + now[active]) ^ text.at(other[active] + now[active])
            same = np.where(x == 0, 8, (64 - _bits(x)) // 8)
            now[active] = np.minimum(now[active] + same, most[active])
            active = active[(same == 8) & (now[active] < most[active])]
        shared[at] = now
    return shared[order]


def _bits(x: np.ndarray) -> np.ndarray:
    """Binary digits of each number."""
    # Without the digit after the leading one, rounding to a float cannot carry over.
    return np.frexp((x & ~(x >> np.uint64(1))).astype(np.float64))[1].astype(np.int64)


def lower_bound(text: Bytes, order: np.ndarray, other: Bytes, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each query window of ``other`` stands among the sorted windows of ``text``, and whether it is there."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(order))

    def compare(places: np.ndarray, which: np.ndarray) -> np.ndarray:
        """-1, 0, 1: the window at that place against the query."""
        result = np.zeros(len(which), np.int64)
        todo = np.arange(len(which))
        for at in [*range(0, width - 8, 8), width - 8]:
            a, b = text.at(order[places[todo]] + at), other.at(queries[which[todo]] + at)
            result[todo[a < b]], result[todo[a > b]] = -1, 1
            todo = todo[a == b]
            if not len(todo):
                break
        return result

    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo]) // 2
        less = compare(mid, todo) < 0
        low[todo[less]], high[todo[~less]] = mid[less] + 1, mid[~less]
        todo = todo[low[todo] < high[todo]]
    found = np.zeros(len(queries), bool)
    inside = np.flatnonzero(low < len(order))
    found[inside] = compare(low[inside], inside) == 0
    return low, found


def equal_windows(text: Bytes, valid: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of valid windows in suffix order, and which of them differ from the one before."""
    order = suffix_array(text, width)
    shared = common_prefixes(text, order, width)
    keep = valid[order]
    group = np.cumsum(shared < width)  # suffixes of a group share the whole window
    order, group = order[keep], group[keep]
    return order, np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)


def _portions(counts: np.ndarray) -> list[np.ndarray]:
    part = (np.cumsum(counts) - counts) // PORTION
    return np.split(np.arange(len(counts)), np.flatnonzero(np.diff(part)) + 1)


def method(width: int, gram: int) -> Method:
    def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
        hashes = tx.Hashes(tx.VALUES[data])
        valid = tx.window_starts(offsets, width)
        none = np.zeros(0, np.int64)
        if not valid.any():
            return Runs(np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64), offsets, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
        # The smallest hash over every stretch of width - gram + 1 positions, by doubling.
        grams = hashes.fixed(gram)
        least, span, wanted = grams, 1, width - gram + 1
        while span * 2 <= wanted:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        count = len(data) - width + 1
        keys = np.minimum(least[:count], least[wanted - span : wanted - span + count])
        valid = valid[:count]
        first = valid.copy()
        first[1:] &= ~(valid[:-1] & (keys[1:] == keys[:-1]))
        begins = np.zeros(count, bool)
        begins[offsets[:-1][offsets[:-1] < count]] = True
        first |= valid & begins
        low = np.flatnonzero(first)
        stop = np.flatnonzero(np.concatenate([first | ~valid, [True]]))
        high = stop[np.searchsorted(stop, low, side="right")]
        return Runs(tx.mix(keys[low]), low, high, hashes.of(low, high + width - 1), offsets, (grams, keys[low]))

    def inner(data: np.ndarray, offsets: np.ndarray, runs: Runs, own: np.ndarray) -> np.ndarray:
        # Two equal windows of one run hold the key's string at two places.
        if not len(own):
            return np.zeros(0, bool)
        grams, least = runs.more
        counts = runs.high[own] - runs.low[own] + width - gram
        equal = grams[tx.spread(runs.low[own], counts)] == np.repeat(least[own], counts)
        return np.add.reduceat(equal, np.cumsum(counts) - counts, dtype=np.int64) > 1

    def content(data: np.ndarray, runs: Runs, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = runs.high[own] - runs.low[own] + width - 1
        return data[tx.spread(runs.low[own], counts)], counts

    def compare(keys, docs, at, sizes, values, starts, counts):
        # Per suffix array: text, sorted distinct windows, and the earliest place of each.
        arrays, out = [], []
        for own in _portions(counts):
            data = values[tx.spread(starts[own], counts[own])]
            begin = np.cumsum(counts[own]) - counts[own]
            edge = np.zeros(len(data) + 1, np.int64)
            edge[begin] += 1
            edge[begin + sizes[own]] -= 1
            text = Bytes(data)
            order, new = equal_windows(text, np.cumsum(edge[:-1]) > 0, width)
            run = np.searchsorted(begin, order, side="right") - 1
            place = at[own][run] + order - begin[run]
            group = np.cumsum(new) - 1
            by = np.lexsort((place, docs[own][run], group))
            run, place, order = run[by], place[by], order[by]
            heads = np.flatnonzero(new)
            later = np.ones(len(order), bool)
            later[heads] = False
            out.append((own[run[later]], place[later]))
            arrays.append((text, order[heads], own[run[heads]], place[heads], np.zeros(len(heads), bool)))
        for j in range(1, len(arrays)):
            for i in range(j):
                (text, order, run, place, gone), (other, queries, run2, place2, gone2) = arrays[i], arrays[j]
                where, found = lower_bound(text, order, other, queries, width)
                q, w = np.flatnonzero(found), where[found]
                earlier = (docs[run[w]] < docs[run2[q]]) | ((docs[run[w]] == docs[run2[q]]) & (place[w] < place2[q]))
                gone2[q[earlier]] = True
                gone[w[~earlier]] = True
        if len(arrays) > 1:
            out += [(run[gone], place[gone]) for _, _, run, place, gone in arrays]
        run, place = (np.concatenate(x) for x in zip(*out))
        return run, place, place + 1

    return Method(runs, content, compare, lambda doc, first: np.ones(len(doc), bool), inner)


def removals(documents: DataFrame, *, width: int = 100, gram: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (byte intervals removed)."""
    if not 8 <= gram <= width:
        raise ValueError("gram must be between 8 and width")

    def finish(block: Block, low: np.ndarray, high: np.ndarray) -> pa.Table:
        gone = tx.covered(len(block.data), low, high + width - 1)
        sizes = np.diff(block.offsets)
        n_removed, digests, spans = [], [], []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            own = gone[a:b]
            count = int(np.count_nonzero(own))
            n_removed.append(count)
            kept = block.data[a:b]
            found = []
            if count:
                turn = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                found = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist())]
                kept = kept[~own]
            spans.append(found)
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table(
            {
                "doc_id": block.ids,
                "n_bytes": pa.array(sizes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()),
                "kept_sha256": digests,
                "spans": pa.array(spans, span),
            }
        )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start bigint, end bigint>>"
    return repeated(documents, method(width, gram), finish, schema, doc_id, text)

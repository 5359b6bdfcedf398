"""Periodic runs of words: every maximal stretch that repeats with a period, by difference-cover LCE.

How far two places of a text agree (their longest common extension, LCE) is answered as follows.  A *cover* is a set
of remainders modulo ``MODULUS`` such that any two positions can be moved by one distance of less than ``MODULUS``
onto covered positions.  Only the suffixes that start at covered positions are sorted: by their first ``MODULUS``
words, then by doubling over the covered position ``MODULUS``, 2 ``MODULUS``, 4 ``MODULUS``... ahead.  A query compares
the few words up to the next synchronised pair of covered positions and then takes the minimum of the common
prefixes between the two in sorted order, from a sparse table.

Runs are enumerated on a harmonic grid: a run of period q and at least 3 q words holds two consecutive multiples
of q whose words equal those q further on.  From each such place the LCE of the text and that of the reversed text give
the run's ends.  The grids of all periods together have n ln n places, which are compared as strided arrays.  Of
one stretch the smallest period counts.

Documents are independent of each other, so every scan task works on its own; several short texts are joined, with a word
of its own after each, and share one structure.  Memory grows with the longest single text.

Defined cases: a null, empty or blank text has no words and no runs; every row gets a row, also repeated
rows and those of null or equal ids; of runs with equal exponent the first counts as the longest, then the smallest
period; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm import text as tx
from clusterlens.llm.staging import column

# A perfect difference set: each difference modulo 31 but zero occurs once.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
LEAST, TIMES = 24, 3  # words of a run, and periods in it, at least
SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
    " n_dropped bigint, runs_sha256 string, collapsed_sha256 string"
)


@lru_cache(maxsize=1)
def _moves() -> np.ndarray:
    """For two remainders, the smallest distance that moves both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    both = np.array([[[inside[a + d] and inside[b + d] for d in range(MODULUS)] for b in range(MODULUS)] for a in range(MODULUS)])
    assert both.any(axis=2).all()
    return both.argmax(axis=2)


class Extensions:
    """Longest common extensions to the right of any two positions of a sequence of numbers from 0 on."""

    def __init__(self, sequence: np.ndarray) -> None:
        n, top = len(sequence), int(sequence.max(initial=0)) + 1
        # Behind the end follow words that equal no others, so that no comparison runs past it.
        self.words = np.concatenate([sequence, top + np.arange(3 * MODULUS)])
        at = np.arange(n + MODULUS + 1)
        self.sampled = at[np.isin(at % MODULUS, COVER)]
        self._sort()
        self._prefixes()

    def _sort(self) -> None:
        """Ranks of the covered suffixes, by their first 1, 2, 4... times ``MODULUS`` words, until they differ."""
        at, count = self.sampled, len(self.sampled)
        # Three words fit one key as long as there are fewer than 2^21 different ones.
        pack = 3 if int(self.words.max()) < 1 << 21 else 1
        keys = []
        for low in range(0, MODULUS, pack):
            key = np.zeros(count, np.int64)
            for k in range(low, min(low + pack, MODULUS)):
                key = (key << 21 if pack > 1 else key) | self.words[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        fresh = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
        rank = np.empty(count, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        # The covered position MODULUS further is as many samples ahead as the cover has remainders.
        self.levels, ahead = [rank], len(COVER)
        while rank.max(initial=0) < count - 1:
            after = np.full(count, -1)
            after[: max(count - ahead, 0)] = rank[ahead:]
            key = rank * (count + 1) + after + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(count, np.int64)
            rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]])) - 1
            self.levels.append(rank)
            ahead *= 2
        self.order = order

    def _compare(self, i: np.ndarray, j: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Equal words from two positions on, at most ``upto`` (below ``2 MODULUS``)."""
        found = np.zeros(len(i), np.int64)
        active = np.flatnonzero(upto > 0)
        step = 0
        while len(active):
            active = active[self.words[i[active] + step] == self.words[j[active] + step]]
            step += 1
            found[active] = step
            active = active[upto[active] > step]
        return found

    def _prefixes(self) -> None:
        """Common prefixes of neighbours in sorted order, and their minima over 1, 2, 4... of them."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, size = self.levels[level], len(COVER) << level
            fits = (a < len(rank)) & (b < len(rank))
            same = np.zeros(len(a), bool)
            same[fits] = rank[a[fits]] == rank[b[fits]]
            a[same] += size
            b[same] += size
            shared[same] += MODULUS << level
        i, j = self.sampled[self.order[:-1]] + shared, self.sampled[self.order[1:]] + shared
        inside = np.maximum(i, j) + MODULUS <= len(self.words)
        shared[inside] += self._compare(i[inside], j[inside], np.full(int(inside.sum()), MODULUS))
        self.rank = self.levels[-1]
        self.levels = []
        self.minima = [shared]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from ``i`` and ``j`` on (different positions, none past the end)."""
        move = _moves()[i % MODULUS, j % MODULUS]
        found = self._compare(i, j, move)
        on = np.flatnonzero(found == move)
        if not len(on):
            return found
        a, b = (self.rank[np.searchsorted(self.sampled, x[on] + move[on])] for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.floor(np.log2(high - low)).astype(np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            table = self.minima[k]
            found[on[own]] += np.minimum(table[low[own]], table[high[own] - (1 << k)])
        return found


def periodic_runs(sequence: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs, by start and period; no period exceeds ``longest // times``.

    ``times`` is at least 3, and ``least`` at least 24 or ``times``.
    """
    groups = []
    for q in range(1, min(longest, len(sequence)) // times + 1):
        grid = sequence[::q]
        equal = grid[:-1] == grid[1:]
        at = np.flatnonzero(equal[:-1] & equal[1:])
        if len(at):
            head = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            groups.append(np.stack([np.full(len(head), q), at[head] * q, np.diff(np.append(head, len(at)))]))
    if not groups:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    # Places in a row, as period, first place and number; a place's run holds all that it reaches.
    q, i, left = np.concatenate(groups, axis=1)
    n, ahead, back = len(sequence), Extensions(sequence), Extensions(sequence[::-1])
    found = []
    while len(q):
        reach = ahead.of(i, i + q)
        # What precedes two positions follows them in the reversed text.
        found.append(np.stack([i - back.of(n - i - q, n - i), i + q + reach, q]))
        step = -(-reach // q)
        on = left > step
        q, i, left = q[on], (i + step * q)[on], (left - step)[on]
    start, end, q = np.concatenate(found, axis=1)
    long = end - start >= np.maximum(least, times * q)
    start, end, q = start[long], end[long], q[long]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[first], end[first], q[first]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def _longest(start: list[int], length: list[int], period: list[int]) -> int:
    """The run of the greatest exact length / period; of equal ones the first, then that of the smallest period."""
    best = 0
    for k in range(1, len(start)):
        more = length[k] * period[best] - length[best] * period[k]
        if more > 0 or more == 0 and (start[k], period[k]) < (start[best], period[best]):
            best = k
    return best


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words as numbers, equal ones alike, with a number of its own behind each text; and where texts begin there."""
    joined, _ = tx.joined(data, starts, ends)
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for w in joined.tobytes().split(b" ")[:-1]], np.int64)
    texts = len(before) - 1
    out = np.empty(len(words) + texts, np.int64)
    shift = np.arange(texts)
    own = np.repeat(shift, np.diff(before))
    out[np.arange(len(words)) + own] = words
    out[before[1:] + shift] = len(known) + shift
    return out, before + np.arange(texts + 1)


def find_runs(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_runs``, the run of the greatest exponent, words dropped by collapsing, and digests."""
    rows = documents.select(column(doc_id).cast("bigint").alias("doc_id"), column(text).cast("string").alias("text"))

    def judge(words: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, run: tuple) -> tuple:
        """A row from the words (numbers of them in the piece) and the runs of one text."""
        low, high, period = run
        gone = tx.covered(len(words), low + period, high)
        kept = words[~gone]
        out, _ = tx.joined(data, starts[kept], ends[kept])
        collapsed = hashlib.sha256(out[: max(len(out) - 1, 0)]).hexdigest()
        first, size, p = low.tolist(), (high - low).tolist(), period.tolist()
        runs = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in zip(first, size, p)).encode()).hexdigest()
        if not first:
            return len(words), 0, None, None, None, None, 0, runs, collapsed
        k = _longest(first, size, p)
        return len(words), len(first), first[k], size[k], p[k], 1000 * size[k] // p[k], int(gone.sum()), runs, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tx.pieces(batch.column(1)):
                starts, ends, before = tx.words(data, offsets, tx.NOT_SPACE)
                sequence, begin = _numbers(data, starts, ends, before)
                low, high, period = periodic_runs(sequence, int(np.diff(before).max(initial=0)))
                cut = np.searchsorted(low, begin)
                found = []
                for d in range(last - first):
                    own, base = slice(cut[d], cut[d + 1]), begin[d]
                    found.append(judge(np.arange(before[d], before[d + 1]), data, starts, ends, (low[own] - base, high[own] - base, period[own])))
                columns = [pa.array(x, pa.int64()) for x in list(zip(*found))[:7]] + [pa.array(x, pa.string()) for x in list(zip(*found))[7:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(tx.frugal(run), SCHEMA)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text; of every tenth document (by crc32 of its id) with its words from some place on replaced by a run.

    With h the crc32 of the decimal id and g = h // 10: if h % 10 is 0, the words from a = g % n on repeat with the
    period 1 + (n - a) // (3 + g % 8).  A null id changes nothing.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def planted(words: Column) -> Column:
        shape = F.struct(F.size(words).alias("n"), F.floor(h / 10).cast("bigint").alias("g"))
        first = F.transform(F.array(shape), lambda s: F.struct(s["n"].alias("n"), s["g"].alias("g"), (s["g"] % s["n"]).cast("int").alias("a")))
        period = F.transform(first, lambda s: F.struct(s["n"].alias("n"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).cast("int").alias("p")))
        return F.transform(period, lambda s: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, s["a"] + (i - s["a"]) % s["p"]))), " "))[0]

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    replaced = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(text))[0]
    return F.when(h % 10 == 0, replaced).otherwise(text)

"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import periodic_runs as pr
from hard_documents import hard_rows, prose


def brute_runs(words, least=24, times=3):
    """Maximal stretches of a period, each with its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text, plant=False):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = planted(doc_id, words) if plant else words
    runs = brute_runs(words)
    order = sorted(runs, key=lambda r: (r[0], r[2]))
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2])) if runs else None
    size = best and best[1] - best[0]
    return (
        doc_id,
        len(words),
        len(runs),
        best and best[0],
        size,
        best and best[2],
        best and 1000 * size // best[2],
        len(gone),
        hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in order).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_cover():
    moves = pr._moves()
    assert moves.shape == (31, 31) and moves.max() < 31


@pytest.mark.parametrize("seed", range(8))
def test_extensions(seed):
    pick = random.Random(seed)
    base = [pick.randrange(1 + seed % 3) for _ in range(pick.choice([5, 40, 300]))]
    s = np.array((base * 4)[: pick.choice([3, 90, 700])])
    pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
    pairs = np.array(pick.sample(pairs, min(len(pairs), 3000)))
    found = pr.Extensions(s).of(pairs[:, 0], pairs[:, 1])
    for (i, j), k in zip(pairs.tolist(), found.tolist()):
        wanted = 0
        while max(i, j) + wanted < len(s) and s[i + wanted] == s[j + wanted]:
            wanted += 1
        assert k == wanted


@pytest.mark.parametrize("seed", range(30))
def test_runs_of_few_letters(seed):
    pick = random.Random(seed)
    s = []
    while len(s) < pick.choice([30, 150, 400]):
        unit = [pick.randrange(3) for _ in range(pick.randrange(1, 40))]
        s += (unit * pick.randrange(1, 8))[: pick.randrange(1, 200)] + [pick.randrange(3) for _ in range(pick.randrange(4))]
    found = pr.periodic_runs(np.array(s), len(s))
    assert sorted(zip(*(x.tolist() for x in found))) == brute_runs(s)


def test_hard_rows(hard, none):
    rows = [r[:2] for r in hard_rows()]
    small = [r for r in rows if len(r[1] or "") < 100_000]
    found = sorted((tuple(r) for r in pr.find_runs(hard).collect() if r.n_words < 20_000), key=repr)
    assert found == sorted((plain_row(*r) for r in small), key=repr)
    assert pr.find_runs(hard).count() == len(rows)
    assert pr.find_runs(none).count() == 0


def test_very_long_run(spark):
    unit = prose(9, 1_000, 5_000)
    row = pr.find_runs(spark.createDataFrame([(1, " ".join([unit] * 60))], "doc_id bigint, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli, row.n_dropped) == (1, 0, 60_000, 1_000, 60_000, 59_000)


def test_planted_runs(spark):
    rows = [(i, prose(i, i % 120, 30) if i % 7 else None) for i in range(300)] + [(None, prose(3, 60))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    frame = frame.select("doc_id", pr.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    found = sorted((tuple(r) for r in pr.find_runs(frame).collect()), key=repr)
    assert found == sorted((plain_row(*r, plant=True) for r in rows), key=repr)
    assert sum(r[2] > 0 for r in found) >= 5

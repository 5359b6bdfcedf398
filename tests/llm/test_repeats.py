"""Byte and word repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from clusterlens.llm import recompression, repeats, suffix_arrays
from clusterlens.llm import text as tx
from hard_documents import hard_rows


def ordered(rows):
    """By id (null last), rows of one id by the hash that the library orders texts with."""

    def tag(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return int(tx.Hashes(tx.VALUES[data]).of(np.array([0]), np.array([len(data)]))[0])

    return sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, tag(r[1])))


def brute_bytes(rows, width):
    seen, out = set(), []
    for doc, text in ordered(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            window = raw[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_words(rows, width):
    first, out = {}, []
    for doc, text in ordered(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        for i in range(len(words) - width + 1):
            first.setdefault(tuple(words[i : i + width]), doc)
    for doc, text in ordered(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] != doc:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def random_rows(seed):
    pick = random.Random(seed)
    rows = []
    for doc in range(60):
        words = [pick.choice("ab") * pick.randrange(1, 4) for _ in range(pick.randrange(0, 120))]
        rows.append((doc // 2 if doc % 10 == 0 else doc, pick.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize("width,gram", [(100, 40), (24, 12)])
def test_bytes_hard_rows(hard, width, gram):
    found = suffix_arrays.removals(hard, width=width, gram=gram).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_bytes(hard_rows(), width)


@pytest.mark.parametrize("width", [13, 4])
def test_words_hard_rows(hard, width):
    found = recompression.removals(hard, width=width).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_words(hard_rows(), width)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_of_two_letters(spark, seed):
    rows = random_rows(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffix_arrays.removals(frame, width=20, gram=9).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_bytes(rows, 20)
    found = recompression.removals(frame, width=7).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_words(rows, 7)


@pytest.mark.parametrize("id_", [None, 7])
def test_rows_of_one_id_are_spread_over_blocks(spark, monkeypatch, id_):
    monkeypatch.setattr(repeats, "BLOCK", 500)
    rows = [(id_ if doc % 3 else doc, text) for doc, text in random_rows(5)]
    rows += [(id_, "")] * 20 + [(id_, None)] * 3 + rows[:4]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_arrays.removals(frame, width=24, gram=12).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_bytes(rows, 24)
    found = recompression.removals(frame, width=5).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_words(rows, 5)
    # The blocks of that id are many, and both passes deal alike.
    import pyarrow as pa

    ids, texts = (pa.array(x) for x in zip(*rows))
    shared = repeats.document_keys(ids[1:2])
    parts = repeats.block_of(ids, texts, 16, shared)
    assert len({p for p, row in zip(parts.tolist(), rows) if row[0] == id_}) > 4
    assert (parts[3:9] == repeats.block_of(ids[3:9], texts[3:9], 16, shared)).all()


def test_several_suffix_arrays_of_one_key_are_merged(spark, monkeypatch):
    method = suffix_arrays.method(12, 8)
    pick = np.random.default_rng(0)
    rows = [bytes(pick.integers(97, 99, 60).astype(np.uint8)) for _ in range(40)]
    values = np.frombuffer(b"".join(rows), np.uint8)
    n = len(rows)
    sizes, counts = np.full(n, 49), np.full(n, 60)
    arguments = np.zeros(n, np.uint64), np.arange(n) // 2, np.arange(n) * 100, sizes, values, np.arange(n) * 60, counts

    def flags():
        run, low, high = method.compare(*arguments)
        return {(int(r), int(p)) for r, a, b in zip(run, low, high) for p in range(a, b)}

    whole = flags()
    monkeypatch.setattr(suffix_arrays, "PORTION", 300)
    assert len(whole) > 100 and flags() == whole


def test_suffix_array_and_prefixes():
    pick = np.random.default_rng(1)
    for k in range(60):
        n = int(pick.integers(1, 300))
        data = np.resize(pick.integers(0, 3, int(pick.integers(1, 60))), n).astype(np.uint8)
        raw, text = data.tobytes(), suffix_arrays.Bytes(data)
        order = suffix_arrays.suffix_array(text, n + 16)
        assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])
        short = suffix_arrays.suffix_array(text, 20)
        shared = suffix_arrays.common_prefixes(text, short, 20)
        for i in range(1, n):
            a, b = raw[short[i - 1] :][:20], raw[short[i] :][:20]
            assert shared[i] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_interior_symbols_are_consistent():
    pick = np.random.default_rng(2)
    passage = pick.integers(0, 5, 40).astype(np.uint64)
    keys = []
    for _ in range(5):
        before, after = pick.integers(0, 5, 30).astype(np.uint64), pick.integers(0, 5, 30).astype(np.uint64)
        names = tx.mix(np.concatenate([before, passage, after]))
        keys.append(recompression.window_keys(names, np.array([0, len(names)]), 13)[30 : 30 + 28].tolist())
    assert all(k == keys[0] for k in keys)


def test_deduplicated_texts(hard):
    found = recompression.deduplicate(hard)
    assert found.columns == hard.columns and found.count() == hard.count()
    texts = {}
    for row in found.collect():
        texts.setdefault(row.doc_id, []).append(row.text)
    given = {r[0]: r[1] for r in hard_rows()}
    assert texts[1] == [given[1]]
    assert texts[4] == [None] and texts[5] == [""] and texts[6] == [given[6]]
    assert texts[13] == [""]
    assert len(texts[2]) == 2 and texts[2][0] == texts[2][1]


def test_empty(none):
    assert suffix_arrays.removals(none).count() == 0
    assert recompression.removals(none).count() == 0
    assert recompression.deduplicate(none).count() == 0


def test_words_whose_names_collide(spark):
    """Thue-Morse words have equal polynomial hashes modulo 2^64, whatever the base: only their bytes tell them apart."""
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    names, *_ = recompression._names(np.frombuffer(f"{one} {other}".encode(), np.uint8), np.array([0, 2049]))
    assert names[0] == names[1]
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"{rest} {one}"), (4, f"{rest} {other}")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = recompression.removals(frame).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_words(rows, 13)
    found = suffix_arrays.removals(frame).drop("spans").collect()
    assert sorted(map(tuple, found), key=repr) == brute_bytes(rows, 100)


def test_equal_slices():
    values = np.frombuffer(b"abcabcabdab", np.uint8)
    starts, counts = np.array([0, 3, 6, 9]), np.array([3, 3, 3, 2])
    for limit in (1, 4, 100):
        found = repeats.alike(values, starts, counts, np.array([0, 0, 0, 1, 3]), np.array([1, 2, 3, 2, 3]), limit)
        assert found.tolist() == [True, False, False, False, True]

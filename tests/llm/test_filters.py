"""Quality rules, decontamination and packing."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from clusterlens.llm import decontamination, packing, quality_rules
from hard_documents import hard_rows, prose


def test_quality_counts_of_hard_rows(hard):
    found = quality_rules.judge(hard)
    rows = found.collect()
    assert len(rows) == len(hard_rows())
    by_text = {r.n_words: r for r in rows}
    assert by_text[61].n_repeat_words == 60 and by_text[61].base_failed
    assert {r.doc_id for r in rows if r.n_words == 0} == {4, 5, 6, None}
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    symbols = next(r for r in rows if r.doc_id == 14)
    assert symbols.n_symbols == symbols.word_chars == 240


def test_quality_limits_adapt_to_the_group(spark):
    pick = random.Random(3)
    rows = []
    for k in range(600):
        source = "code" if k % 2 else "news"
        words = [f"word{pick.randrange(500)}" + ("|" if source == "code" and pick.random() < 0.5 else "") for _ in range(60)]
        rows.append((k, " ".join(words), "en", source))
    rows.append((600, " ".join(f"w{i}###" for i in range(60)), "en", "news"))
    rows.append((601, " ".join(f"w{i}|" for i in range(60)), "en", "small"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r for r in quality_rules.judge(frame, min_rows=100).collect()}
    assert not [k for k in range(600) if not found[k].kept]
    assert "symbol_share" in found[600].failed
    assert quality_rules.keep(frame, min_rows=100).columns == frame.columns


def test_quality_keeps_columns_and_empty(hard, none):
    kept = quality_rules.keep(hard)
    assert kept.columns == hard.columns and 0 < kept.count() < hard.count()
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0


def test_bucket_keeps_eight_digits(spark):
    rows = spark.createDataFrame([(v,) for v in (0, 1, 255, 256, 257, 1000, 123456)], "v bigint")
    assert [r[0] for r in rows.select(quality_rules.bucket(F.col("v"))).collect()] == [0, 1, 255, 256, 256, 1000, 123392]


def brute_hits(rows, items, size):
    found = []
    for doc, text in rows:
        words = [w.decode() for w in decontamination.WORD.findall((text or "").encode().lower())]
        hit, own = set(), set()
        for item, item_text in items:
            theirs = [w.decode() for w in decontamination.WORD.findall((item_text or "").encode().lower())]
            n = min(size, len(theirs))
            windows = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    own.add(item)
        found.append((doc, len(words), len(hit), sorted(str(x) for x in own if x is not None)))
    return sorted(found, key=repr)


ITEMS = [(1, prose(1, 60)), (2, "A b. C"), (10, "über"), (None, "no id"), (4, None), (5, "..."), (2, "a, B-c"), (11, prose(1, 60)[10:80])]


def test_decontamination_against_brute_force(spark, hard):
    items = spark.createDataFrame([(*i, 1) for i in ITEMS], "item_id bigint, text string, n_hit int")
    expected = brute_hits([(r[0], r[1]) for r in hard_rows()], ITEMS, 10)
    for limit in (8 << 20, 150):  # one block, and several
        found = decontamination.scan(hard, items, limit=limit)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found.collect()), key=repr) == expected
        spans = {(r.doc_id, r.n_words): sum(s.end - s.start for s in r.spans) for r in found.collect()}
        assert all(spans[(d, w)] == h for d, w, h, _ in expected)


def test_decontamination_cleans(spark, hard, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.clean(hard, items, drop_share=0.7)
    assert found.columns == hard.columns
    kept = {r.doc_id: r.text for r in found.collect()}
    given = {r[0]: r[1] for r in hard_rows()}
    assert 11 not in kept and 12 not in kept
    assert kept[1].startswith(prose(2, 50)) and prose(1, 60)[:40] not in kept[1]
    assert kept[8] == given[8] and kept[14] == given[14] and kept[4] is None
    again = decontamination.scan(found, items).where("n_hit > 0")
    assert again.count() == 0
    assert decontamination.clean(none, items).count() == 0
    nothing = decontamination.scan(hard, items.limit(0))
    assert nothing.where("n_hit > 0").count() == 0 and nothing.count() == hard.count()


def test_bounds_are_optimal():
    pick = np.random.default_rng(4)
    for _ in range(40):
        n, buckets = int(pick.integers(1, 9)), int(pick.integers(1, 5))
        lengths, counts = np.sort(pick.choice(50, n, replace=False)), pick.integers(1, 20, n)
        bounds, waste = packing.bounds(lengths, counts, buckets)

        def padding(chosen):
            return sum(c * (min(b for b in chosen if b >= x) - x) for x, c in zip(lengths, counts))

        best = min(padding([*some, lengths[-1]]) for k in range(min(buckets, n)) for some in itertools.combinations(lengths[:-1], k))
        assert waste == best == padding(bounds) and len(bounds) <= buckets


def test_bounds_of_many_lengths():
    pick = np.random.default_rng(5)
    for n, buckets in ((200, 16), (257, 3), (64, 1)):
        lengths = np.sort(pick.choice(20_000, n, replace=False)).astype(np.int64)
        counts = (pick.pareto(1, n) * 10 + 1).astype(np.int64)
        least = {0: 0}  # of the first j lengths
        for _ in range(buckets):
            again = {0: 0}
            for j in range(1, n + 1):
                again[j] = min(least[i] + int((counts[i:j] * (lengths[j - 1] - lengths[i:j])).sum()) for i in range(j) if i in least)
            least = again
        bounds, waste = packing.bounds(lengths, counts, buckets)
        upper = np.array(bounds)[np.searchsorted(bounds, lengths)]
        assert waste == least[n] == int((counts * (upper - lengths)).sum()) and len(bounds) <= buckets
    lengths = np.arange(1, 100_001, dtype=np.int64)
    assert len(packing.bounds(lengths, np.ones(100_000, np.int64), 16)[0]) == 16


def test_packed_batches(spark, data, hard, none):
    for frame in (data("documents"), hard):
        rows = packing.pack(frame, buckets=6, budget=2000, slices=3).collect()
        assert len(rows) == frame.count()
        batches = {}
        for r in rows:
            assert r.n_tokens <= r.bound
            batches.setdefault((r.bucket, r.batch), []).append(r)
        for (bucket, batch), own in batches.items():
            size = max(2000 // max(own[0].bound, 1), 1)
            assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) <= size
            assert len({r.bound for r in own}) == 1
            # Only the last batch of a bucket may be short.
            assert len(own) == size or batch == max(b for k, b in batches if k == bucket)
    assert packing.pack(none).count() == 0

"""SimHash fingerprints and components against brute force."""

import random

import numpy as np
from xxhash import xxh64_intdigest

from clusterlens.llm import simhash
from clusterlens.llm.components import components
from hard_documents import hard_rows, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ")
    words = [w for w in words if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(values, budget=3):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (doc, _), root in zip(rows, roots):
        if doc is not None:
            least[root] = min(doc, least.get(root, doc))
    return sorted(((doc, f"{p:016x}", least.get(root)) for (doc, _), p, root in zip(rows, prints, roots)), key=repr)


def test_hard_rows(hard):
    found = simhash.near_duplicates(hard)
    assert sorted(map(tuple, found.collect()), key=repr) == expected([(r[0], r[1]) for r in hard_rows()])


def test_near_copies(spark, data):
    base, pick = prose(7, 400), random.Random(8)
    rows = [(r.doc_id, r.text) for r in data("documents").collect()]
    for k in range(150):
        words = base.split(" ")
        for _ in range(pick.randrange(0, 5)):
            words[pick.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_trie_finds_all_pairs_at_every_top_depth():
    pick = np.random.default_rng(9)
    centre = pick.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << pick.integers(0, 64, (4, 40, 15), dtype=np.uint64)
    values = np.unique(np.concatenate([centre, *[(centre[:, None] ^ np.bitwise_xor.reduce(flips[:k], axis=0)).ravel() for k in (1, 2, 3, 4)]]))
    n = len(values)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    wanted = {(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    found = [(int(min(i, j)), int(max(i, j))) for a, b in simhash.near_pairs(values, (0, n), (0, n), 0, 0, 3) for i, j in zip(a, b)]
    assert len(found) == len(set(found)) and set(found) == wanted


def test_links_over_split_tries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUBTRIE", 64)
    pick = np.random.default_rng(10)
    values = [int(v) for v in pick.integers(0, 1 << 63, 300, dtype=np.uint64)]
    values += [v ^ (1 << int(a)) ^ (1 << int(b)) for v, a, b in zip(values[:100], pick.integers(0, 64, 100), pick.integers(0, 64, 100)) if a != b]
    values = sorted(set(values))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    stars = {r.node: r.component for r in components(simhash.links(frame, len(values), 3)).collect()}
    roots = plain_components(values)
    groups, other = {}, {}
    for v, root in zip(signed, roots):
        groups.setdefault(root, set()).add(v)
        other.setdefault(stars.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, other.values()))


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(7, 7), (3, 2)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {i: i // 50 * 50 for i in range(200) if i % 50}


def test_one_document_of_each_component_stays(hard, none):
    kept = simhash.deduplicate(hard)
    assert kept.columns == hard.columns
    wanted = {c for _, _, c in expected([(r[0], r[1]) for r in hard_rows()])}
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == wanted and len(ids) == len({f for f in plain_components([plain_fingerprint(r[1]) for r in hard_rows()])})
    assert simhash.deduplicate(none).count() == 0 and simhash.near_duplicates(none).count() == 0

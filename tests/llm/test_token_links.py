"""Token links against a plain version over pairs of byte ranges."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from clusterlens.llm import token_links as tl
from clusterlens.llm.queries_tokens import tokenizer_files
from hard_documents import hard_rows, prose


@pytest.fixture(scope="module")
def files():
    return tokenizer_files()


def plain_tokens(text, vocabularies):
    if not text:
        return None
    found = []
    for v in vocabularies:
        ids = v.encode([text])[0]
        tokens = [bytes(v.bytes[v.starts[i] : v.starts[i] + v.sizes[i]]) for i in ids]
        if b"".join(tokens) != b" " + text.encode():
            return None
        found.append([(i, sum(map(len, tokens[:k])), sum(map(len, tokens[: k + 1]))) for k, i in enumerate(ids)])
    return found


def plain_rows(rows, vocabularies):
    tokens = [plain_tokens(t, vocabularies) for _, t in rows]
    links = [[(a[0], b[0]) for a in x[0] for b in x[1] if a[1] < b[2] and b[1] < a[2]] if x else [] for x in tokens]
    count = Counter(pair for own in links for pair in set(own))
    highest = Counter()
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    out = []
    for (doc, _), x, own in zip(rows, tokens, links):
        if not x:
            out.append((doc, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({a[2] for a in x[0]} & {b[2] for b in x[1]})
        groups = []
        for low, high in zip([0, *cuts[:-1]], cuts):
            groups.append([[i for i, s, e in side if low <= s and e <= high] for side in x])
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        together = sum(len(a) * len(b) for a, b in groups)
        best = sum(count[p] == highest[p[0]] for p in own)
        out.append((doc, len(x[0]), len(x[1]), len(cuts), len(own), together, best, sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def texts():
    pick = random.Random(5)
    words = ["the", "Straße", "don't", "naïve", "漢字", "😀👍🏽", "<|endoftext|>", "</s>", "<unk>", "<0x41>", "  ", "\n\n", "\t", "antidisestablishmentarianism", "3.14159", "{}[]();", "▁", " ", "ﬁ"]
    return ["".join(pick.choice(words) + pick.choice([" ", "", "\n"]) for _ in range(pick.randrange(0, 30))) for _ in range(120)]


def test_products():
    pick = np.random.default_rng(1)
    for _ in range(20):
        a, b = (pick.integers(0, 3, (pick.integers(1, 9), 7)) for _ in range(2))

        def csr(m):
            row, at = np.nonzero(m)
            return tl.Csr(np.concatenate([[0], np.cumsum((m > 0).sum(axis=1))]), at, m[row, at], m.shape[1])

        found = csr(a).times(csr(b).transposed())
        dense = np.zeros((len(a), len(b)), np.int64)
        dense[np.repeat(np.arange(len(a)), np.diff(found.ends)), found.at] = found.values
        assert (dense == a @ b.T).all() and (found.values > 0).all()
        assert (csr(a).row_sizes(csr(b).transposed()) == (a > 0).astype(int) @ (b.T > 0).sum(axis=1)).all()


def test_byte_alphabet():
    assert len(tl.byte_alphabet()) == 256 and tl.byte_alphabet()["Ġ"] == 0x20 and tl.byte_alphabet()["Ċ"] == 0x0A


@pytest.mark.parametrize("block", [tl.BLOCK, 200])
def test_rows_in_one_and_in_many_blocks(spark, files, block):
    rows = [(i // 2, t) for i, t in enumerate(texts())] + [(None, None), (3, ""), (None, "one more"), (4, prose(1, 80)), (4, prose(1, 80))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = sorted((tuple(r) for r in tl.align(frame, *files, block=block).collect()), key=repr)
    assert found == plain_rows(rows, tl._vocabularies(*files))


def test_hard_rows(hard, none, files):
    found = sorted((tuple(r) for r in tl.align(hard, *files).collect()), key=repr)
    assert [r[0] for r in found] == sorted([r[0] for r in hard_rows()], key=repr)
    long = next(r for r in found if r[0] == 7)
    assert long[4] >= long[3] > 40_000
    assert tl.align(none, *files).count() == 0


def test_links_share_bytes(spark, files):
    rows = tl.links_of(spark.createDataFrame([(1, "naïve 😀 tokens"), (2, "two two tokens"), (3, None)], "doc_id bigint, text string"), *files).collect()
    row, second, third = sorted(rows, key=lambda r: r.doc_id)
    assert third.links == [] and [(x.a_place, x.b_place) for x in second.links] == [(0, 0), (1, 1), (2, 2)]
    assert sum(x.shared_bytes for x in row.links) == len(" naïve 😀 tokens".encode())
    one, two = tl._vocabularies(*files)
    assert sorted((x.a, x.b) for x in row.links) == sorted(
        (a[0], b[0]) for x in [plain_tokens("naïve 😀 tokens", (one, two))] for a in x[0] for b in x[1] if a[1] < b[2] and b[1] < a[2]
    )


def test_segments_join_to_the_tokens_of_the_text(files):
    vocabularies = tl._vocabularies(*files)
    for text in [t for t in texts() if t and "▁" not in t] + [" ", "a ", "é  ", "\n "] + [r[1] for r in hard_rows() if r[1] and len(r[1]) < 100_000]:
        segments = tl.SEGMENT.findall(" " + text)
        assert "".join(segments) == " " + text
        for v in vocabularies:
            ids, counts, good = tl.segment_tokens(segments, v)
            assert good.all() and counts.sum() == len(ids) and ids.tolist() == v.encode([text])[0]
    assert not [t for v in vocabularies for t in np.split(v.bytes, v.starts[1:]) if re.search("[!-~\u00a1-\u052f] ", t.tobytes().decode(errors="ignore"))]


def test_ranks_encode_ascii_like_the_definition(files):
    one = tl.byte_level(files[0])
    assert one._ascii
    some = [f"{a}{chr(i)}{b}{chr(j)} x" for i in range(128) for j in range(128) for a, b in (("", "a"), ("1 ", ""))]
    some += ["<|endoftext|>", "don't we'LL I'm", "   \n\n  a  ", "0123456789abcdef" * 9, "e" * 300, prose(8, 300)]
    assert [one._ascii(t) for t in some] == one.encode(some)


def test_a_segment_that_is_not_given_back(files):
    segments = [" one", " two▁three", " four", " fünf "]
    for v, wanted in zip(tl._vocabularies(*files), ([True] * 4, [True, False, True, True])):
        ids, counts, good = tl.segment_tokens(segments, v)
        assert good.tolist() == wanted and ids.tolist() == sum((v.encode([s[1:]])[0] for s in segments), [])


def test_texts_that_tokens_do_not_give_back(spark, files):
    definition, model = files
    one, two = tl._vocabularies(definition, model)
    assert plain_tokens("plain", (one, two))
    broken = [t for t in texts() if t and plain_tokens(t, (one, two)) is None]
    rows = list(enumerate(broken))
    found = tl.align(spark.createDataFrame(rows, "doc_id bigint, text string"), *files).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, 0, "") for r in found)

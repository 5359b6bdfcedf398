"""The prefix tree of conversations: exact round trip, sharing, positions and attention."""

import random

import pytest

from clusterlens.llm import chat_tree

CONTROL = ["</s>[INST] ok [/INST]", "<|im_end|>", "a\\<|im_start|>user<|im_sep|>", "\\\\n\\", "<s><<|im_end|>>", "\n\n", ""]


def rows():
    pick = random.Random(3)
    out = []
    for k in range(60):
        turns = [("system", "be brief"), ("user", f"hi {pick.randrange(3)}"), ("assistant", pick.choice(["yes", "no"])), ("user", pick.choice(CONTROL)), ("assistant", pick.choice(CONTROL))]
        turns = turns[: pick.randrange(1, 6)] if k % 7 else [("user", pick.choice(CONTROL)), ("assistant", "x" * 3000)]
        out += [(k, t, role, text, 1, "z", 9) for t, (role, text) in enumerate(turns)]
    out += [(100, t, "user", f"line {t % 3}", 1, "z", 9) for t in range(300)]  # a long one
    out += [(101, t, "user", f"line {t % 3}", 1, "z", 9) for t in range(299)]  # and its prefix
    out += [(200, 5, "user", "tie b", 1, "z", 9), (200, 5, "user", "tie a", 1, "z", 9), (200, None, None, None, 1, "z", 9)]
    out += [(201, 1, "odd\nrole <|im_sep|>", "t", 1, "z", 9), (None, 0, "user", "no id", 1, "z", 9), (None, 1, "assistant", None, 1, "z", 9)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "conv_id bigint, turn bigint, role string, text string, depth int, leaf string, owner int").repartition(3)


@pytest.fixture(scope="module")
def tree(table):
    return chat_tree.build(table)


def expected():
    found = {}
    for conv, turn, role, text, *_ in rows():
        found.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in found.items()}


def test_round_trip(tree):
    read = {r.conv_id: r for r in chat_tree.read_back(tree).collect()}
    wanted = expected()
    assert set(read) == set(wanted)
    for conv, turns in wanted.items():
        assert [(t.role, t.text) for t in read[conv].turns] == turns
        assert read[conv].loss_text == "".join(t for r, t in turns if r == "assistant")


def test_emitted_once_depth_first_with_positions_and_ancestors(tree):
    segments = sorted(tree.segments.collect(), key=lambda s: s.start)
    at = 0
    for s in segments:  # the emission has no gaps
        assert s.start == at and len(s.text) == s.length
        at += s.length
    emitted = "".join(s.text for s in segments)
    prefixes = {tuple(turns[: k + 1]) for turns in expected().values() for k in range(len(turns))}
    assert emitted.count(chat_tree.START) == len(prefixes)
    whole = {r.leaf: r.text for r in chat_tree.formatted(tree).collect()}
    for s in segments:
        # What a segment attends to, and itself, is the whole conversation up to its end.
        seen = "".join(emitted[a.start : a.end] for a in s.attends)
        assert seen + s.text == whole[s.leaf] and s.position == len(seen)
    # A tree is emitted in one stretch.
    order = [s.tree for s in segments]
    assert len([k for k in range(1, len(order)) if order[k] != order[k - 1]]) + 1 == len(set(order))


def test_escaped_texts_hold_no_control_string(spark):
    frame = spark.createDataFrame([(c,) for c in [*CONTROL, *chat_tree.CONTROLS, "[INST[INST]]"]], "t string")
    for given, escaped, back in frame.select("t", chat_tree.escape(frame.t), chat_tree.unescape(chat_tree.escape(frame.t))).collect():
        assert back == given and not any(c in escaped for c in chat_tree.CONTROLS)


def test_empty(table):
    tree = chat_tree.build(table.limit(0))
    assert tree.segments.count() == 0 and chat_tree.read_back(tree).count() == 0

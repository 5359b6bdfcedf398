"""Boolean trigram queries of regular expressions.

Every text that an expression matches holds, ASCII letters folded to lower case, all trigrams of at least one
*clause*.  An expression whose query has an empty clause demands nothing and is tried on every text.

The expression is walked once.  Stretches that stand for few strings (literals, small classes, alternatives,
optional parts) are multiplied out; each string gives the clause of its trigrams.  Conditions of consecutive
stretches are combined with AND, alternatives with OR.  Whatever is not understood demands nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _parser as parser

STRINGS = 32  # that a stretch may stand for
CLAUSES = 256  # that a query may have

Clause = frozenset[str]
Query = frozenset[Clause]
ALWAYS: Query = frozenset([frozenset()])


def folded(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _absorbed(clauses: Iterable[Clause]) -> Query:
    """Without clauses that demand more than another one."""
    kept: list[Clause] = []
    for clause in sorted(set(clauses), key=lambda c: (len(c), sorted(c))):
        if not any(k <= clause for k in kept):
            kept.append(clause)
    return frozenset(kept) if len(kept) <= CLAUSES else ALWAYS


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > CLAUSES:  # either condition alone holds as well
        return min((q for q in (a, b) if q != ALWAYS), key=len, default=ALWAYS)
    return _absorbed(x | y for x in a for y in b)


def either(queries: Iterable[Query]) -> Query:
    return _absorbed(clause for query in queries for clause in query)


def of_strings(strings: Iterable[str]) -> Query:
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


class Part:
    """What a part of an expression stands for: a few strings, or else a condition."""

    def __init__(self, strings: frozenset[str] | None, query: Query = ALWAYS) -> None:
        self.strings = strings if strings is not None and len(strings) <= STRINGS else None
        self.query = query if strings is None else of_strings(strings)


def _class(items: list) -> Part:
    found: set[str] = set()
    for kind, value in items:
        if kind is parser.LITERAL:
            found.add(folded(chr(value)))
        elif kind is parser.RANGE and value[1] - value[0] < 4 * STRINGS:
            found.update(folded(chr(c)) for c in range(value[0], value[1] + 1))
        else:
            return Part(None)
    return Part(frozenset(found)) if len(found) <= STRINGS // 4 else Part(None)


def _repeat(low: int, high: int, part: Part) -> Part:
    if low == 0:
        return Part(part.strings | {""}) if part.strings is not None and high == 1 else Part(None)
    whole = _sequence([part] * min(low, 8))
    return whole if low == high and low <= 8 else Part(None, whole.query)


def _sequence(parts: Iterable[Part]) -> Part:
    query, now, exact = ALWAYS, frozenset([""]), True
    for part in parts:
        if part.strings is not None and len(part.strings) * len(now) <= STRINGS:
            now = frozenset(a + b for a in now for b in part.strings)
            continue
        query, exact = both(query, of_strings(now)), False
        if part.strings is not None:
            now = part.strings
        else:
            query, now = both(query, part.query), frozenset([""])
    return Part(now) if exact else Part(None, both(query, of_strings(now)))


def _part(kind, value) -> Part:
    if kind is parser.LITERAL:
        return Part(frozenset([folded(chr(value))]))
    if kind is parser.IN:
        return _class(value)
    if kind is parser.SUBPATTERN:
        return _whole(value[3])
    if kind is parser.BRANCH:
        ways = [_whole(way) for way in value[1]]
        if all(way.strings is not None for way in ways):
            return Part(frozenset().union(*[way.strings for way in ways]))
        return Part(None, either(way.query for way in ways))
    if kind in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
        return _repeat(int(value[0]), int(value[1]), _whole(value[2]))
    return Part(frozenset([""])) if kind is parser.AT else Part(None)


def _whole(items) -> Part:
    return _sequence(_part(kind, value) for kind, value in items)


def trigram_query(pattern: str) -> Query:
    """The clauses of trigrams, one of which holds for every folded text that the pattern matches."""
    re.compile(pattern)
    return _whole(parser.parse(pattern)).query

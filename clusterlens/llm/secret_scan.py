"""Secrets in texts, found through a trigram inverted index; DataFrame functions only.

1. Each rule's regular expression gives a Boolean trigram query (:mod:`clusterlens.llm.trigram_queries`).
2. The index has a posting (trigram, text) for each trigram that some query names; texts are known by a hash, so copies
   share their postings.  It is written to the shared folder.
3. Postings are intersected: a clause holds for the texts that have as many of its trigrams as it has.  A text is a
   candidate of a rule if one of the rule's clauses holds.
4. Candidates are verified: the expression runs over the texts of its candidates only.  Rules without mandatory
   trigrams run over all texts.

Texts whose hash collides only become candidates together.  Documents are joined to candidates by hash and a salt, so
that copies that make up a large share of all rows are dealt over many tasks; a small candidate table is broadcast by the
optimiser, whose threshold checks its size, and then no text moves.

Spans count code points, their end is exclusive.  The matches of a rule are the leftmost ones that do not overlap; those
that are too short are dropped afterwards.  Spans of different rules may overlap.

Defined cases: a null text is empty and has no spans; every row gets a row, also repeated rows and those of null or equal
ids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.staging import column, stage
from clusterlens.llm.trigram_queries import ALWAYS, trigram_query

SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression (of the common subset of Java, RE2 and Python) and the least length of one of its groups."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    # Of [0-9a-f]+, the matches of 32 characters and more are exactly these.
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[0-9A-Za-z_-]{35}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{10,}\\.eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """``trigram, key`` for the given trigrams; ``texts`` has ``key`` and ``text``."""
    named = F.array(*[F.lit(t) for t in trigrams])
    held = _let(F.lower("text"), lambda text: F.filter(named, lambda t: F.contains(text, t)))
    return texts.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``key, rules``: the rules with mandatory trigrams one of whose clauses holds for the text."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    clauses = [
        (kind, number, len(clause), trigram)
        for kind, query in queries.items()
        if query != ALWAYS
        for number, clause in enumerate(sorted(query, key=sorted))
        for trigram in sorted(clause)
    ]
    wanted = texts.sparkSession.createDataFrame(clauses, "kind string, clause int, size int, trigram string")
    index = stage(postings(texts, sorted({trigram for *_, trigram in clauses})), "trigrams") if clauses else None
    if index is None:
        return texts.sparkSession.createDataFrame([], "key bigint, rules array<string>")
    met = index.join(wanted, "trigram").groupBy("kind", "clause", "size", "key").count().where(F.col("count") == F.col("size"))
    # At most one entry per rule.
    return met.groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("rules"))


def _positions(found: Column, between: Column) -> Column:
    """Where the strings ``found`` start, if ``between`` are the texts before, between and after them."""
    return F.aggregate(
        found,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts")),
        lambda state, x: _let(
            state["end"] + F.length(F.get(between, F.size(state["starts"]))),
            lambda start: F.struct((start + F.length(x)).alias("end"), F.array_append(state["starts"], start).alias("starts")),
        ),
        lambda state: state["starts"],
    )


_SPAN = "array<struct<start int, place int, end int, kind string>>"


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's spans in a text, as an array of (start, place, end, kind)."""

    def spans(found: Column) -> Column:
        between = F.split(text, rule.pattern, -1)
        judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        return _let(
            F.struct(_let(between, lambda b: _positions(found, b)).alias("starts"), judged.alias("judged")),
            lambda s: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.length(F.get(s["judged"], i)) >= rule.least),
                lambda i: F.struct(
                    F.get(s["starts"], i).alias("start"),
                    F.lit(place).alias("place"),
                    (F.get(s["starts"], i) + F.length(F.get(found, i))).alias("end"),
                    F.lit(rule.kind).alias("kind"),
                ),
            ),
        )

    none = F.array().cast(_SPAN)
    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def scan(documents: DataFrame, rules: Sequence[Rule] = (*BASE, *MORE), *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id and ``spans``, an array of (start, place of the rule, end, kind) by start, then rule."""
    rows = documents.select(column(doc_id).alias("doc_id"), F.coalesce(column(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.xxhash64("text"))
    found = stage(candidates(keyed.select("key", "text"), rules), "secret-candidates")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(found.select("key", "rules", salts), ["key", "salt"], "left")

    def of(place: int, rule: Rule) -> Column:
        spans = rule_spans(F.col("text"), rule, place)
        if trigram_query(rule.pattern) == ALWAYS:
            return spans
        return F.when(F.array_contains("rules", rule.kind), spans).otherwise(F.array().cast(_SPAN))

    spans = F.concat(*[of(place, rule) for place, rule in enumerate(rules)])
    return joined.select("doc_id", F.array_sort(spans).alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

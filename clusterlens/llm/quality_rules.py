"""Quality rules with adaptive limits instead of fixed cutoffs, in DataFrame functions only.

Each document gets a few counts and from them integer measures.  The distribution of each measure
per language and source is kept as a mergeable quantile sketch: the number of documents per
bucket, where a bucket holds the values that agree in their eight leading binary digits (relative
error below 1/128).  Sketches merge by adding counts, so those of a language and of all documents
come from those of the groups.  A group's limits are its quartiles widened by three times the distance
between them and the measure's own slack; a group of under ``min_rows`` documents uses its
language's sketch, and a small language that of all documents.  The limits are joined back to the documents.

Defined cases: a null or empty text has no words and fails the base rule; null languages and
sources are groups like any other; repeated rows count and are kept or dropped alike; an empty
table gives an empty result; further columns are passed through by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.llm.staging import column, stage


@dataclass(frozen=True)
class Measure:
    """``scale * above // below``, judged against a lower and an upper limit or only an upper one."""

    name: str
    above: str
    below: str
    scale: int
    slack: int
    both: bool = False


MEASURES = (
    Measure("symbol_share", "n_symbols", "word_chars", 10_000, 500),
    Measure("upper_share", "n_upper", "word_chars", 10_000, 2_000),
    Measure("dup_line_share", "n_dup_lines", "n_lines", 10_000, 2_000),
    Measure("repeat_share", "n_repeat_words", "n_words", 10_000, 1_500),
    Measure("word_length", "word_chars", "n_words", 100, 150, both=True),
)
SPREAD, WINDOW, MIN_WORDS, MAX_REPEAT = 3, 8, 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, size: int) -> Column:
    """Words in windows of that size that occur twice or more; windows are compared by 64-bit hash."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))

    def covered(found: Column) -> Column:
        by_hash = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # A window is repeated if a neighbour in hash order is equal.
        again = let(
            by_hash,
            lambda a: F.transform(
                F.filter(
                    a,
                    lambda x, k: F.coalesce(F.get(a, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(a, k + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["i"],
            ),
        )
        return F.aggregate(
            F.array_sort(again),
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + p + size - F.greatest(p, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(
        let(hashes, lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found)))
    )


def counts(text: Column) -> Column:
    """A struct with the counts of one text, all ``bigint``."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(
        words,
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w, WINDOW).alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    parts = let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda p: F.struct(
            *[p["w"][c].cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")],
            *[p["l"][c].cast("bigint").alias(c) for c in ("n_lines", "n_dup_lines")],
            symbols.cast("bigint").alias("n_symbols"),
            upper.cast("bigint").alias("n_upper"),
        ),
    )
    return parts


def value(measure: Measure, of: str) -> Column:
    return F.expr(f"({measure.scale} * {of}.{measure.above}) div greatest({of}.{measure.below}, 1)")


def bucket(x: Column) -> Column:
    """The value with all but its eight leading binary digits set to zero."""
    return F.call_function("shiftleft", F.call_function("shiftright", x, _shift(x)), _shift(x))


def _shift(x: Column) -> Column:
    return F.greatest(F.length(F.bin(x)) - 8, F.lit(0))


def sketches(measured: DataFrame, lang: str, source: str, of: str) -> DataFrame:
    """Documents per language, source, measure and bucket; a sum of rows merges sketches."""
    values = F.array(*[F.struct(F.lit(m.name).alias("measure"), value(m, of).alias("value")) for m in MEASURES])
    return (
        measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(values).alias("v"))
        .groupBy("lang", "source", F.col("v.measure").alias("measure"), bucket(F.col("v.value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def limits(sketch: DataFrame, min_rows: int) -> DataFrame:
    """Per language and source: a map from measure to its lower and upper limit."""
    groups = sketch.groupBy("lang", "source", "measure").agg(F.sum("n").alias("own"))
    per_lang = groups.groupBy("lang", "measure").agg(F.sum("own").alias("in_lang"))
    level = F.when(F.col("own") >= min_rows, 2).when(F.col("in_lang") >= min_rows, 1).otherwise(0)
    wanted = (
        groups.alias("g")
        .join(per_lang.alias("p"), F.col("g.lang").eqNullSafe(F.col("p.lang")) & (F.col("g.measure") == F.col("p.measure")))
        .select("g.lang", "g.source", "g.measure", level.alias("level"))
        .withColumns({"key_lang": F.when(F.col("level") >= 1, F.col("lang")), "key_source": F.when(F.col("level") == 2, F.col("source"))})
    )
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("key_lang"), F.col("source").alias("key_source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("key_lang"), F.lit(None).cast("string").alias("key_source")),
            F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("key_lang"), F.lit(None).cast("string").alias("key_source")),
        )
    )
    merged = sketch.select("*", levels.alias("k")).groupBy("k.level", "k.key_lang", "k.key_source", "measure", "bucket").agg(F.sum("n").alias("n"))
    key = ["level", "key_lang", "key_source", "measure"]
    ranked = merged.select(
        "*",
        F.sum("n").over(Window.partitionBy(*key).orderBy("bucket")).alias("upto"),
        F.sum("n").over(Window.partitionBy(*key)).alias("total"),
    )
    quartiles = ranked.groupBy(*key).agg(
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bucket"))).alias("q3"),
    )
    slack = F.create_map(*[F.lit(x) for m in MEASURES for x in (m.name, m.slack)])
    both = F.col("measure").isin(*[m.name for m in MEASURES if m.both])
    width = SPREAD * (F.col("q3") - F.col("q1")) + slack[F.col("measure")]
    bounds = F.struct(F.when(both, F.col("q1") - width).otherwise(F.lit(0)).alias("low"), (F.col("q3") + width).alias("high"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key]
    return (
        wanted.alias("w")
        .join(quartiles.alias("q"), same[0] & same[1] & same[2] & same[3])
        .select("w.lang", "w.source", "w.measure", "q.q1", "q.q3")
        .groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("measure", bounds))).alias("limits"))
    )


def _judged(rows: DataFrame, min_rows: int) -> DataFrame:
    """Rows of ``lang``, ``source``, counts ``q`` and more, with ``failed``: the names of the broken rules."""
    found = stage(limits(sketches(rows, "lang", "source", "q"), min_rows), "quality-limits")
    found = found.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "limits")
    joined = rows.join(found, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    checks = [
        F.when(
            (value(m, "q") > F.col("limits")[m.name]["high"]) | (value(m, "q") < F.col("limits")[m.name]["low"]),
            F.lit(m.name),
        )
        for m in MEASURES
    ]
    base = (F.col("q.n_words") < MIN_WORDS) | (F.col("q.n_repeat_words") * 100 > F.col("q.n_words") * MAX_REPEAT)
    return joined.select(*rows.columns, F.array_compact(F.array(F.when(base, F.lit("base")), *checks)).alias("failed"))


def judge(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = 200
) -> DataFrame:
    """Per document: id, the counts, ``base_failed``, ``failed`` (broken rules) and ``kept``."""
    rows = documents.select(
        column(doc_id).alias("doc_id"), column(lang).alias("lang"), column(source).alias("source"), counts(column(text)).alias("q")
    )
    found = _judged(stage(rows, "quality-rules"), min_rows)
    return found.select(
        "doc_id",
        *[F.col(f"q.{c}").alias(c) for c in COUNTS],
        F.array_contains("failed", "base").alias("base_failed"),
        "failed",
        (F.size("failed") == 0).alias("kept"),
    )


def keep(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = 200) -> DataFrame:
    """The documents that break no rule, with all their columns, which travel as one struct and may have any names.

    The counts are computed once and staged with their documents.
    """
    whole = F.struct(*[column(c) for c in documents.columns])
    rows = documents.select(whole.alias("row"), column(lang).alias("lang"), column(source).alias("source"), counts(column(text)).alias("q"))
    return _judged(stage(rows, "quality-rules"), min_rows).where(F.size("failed") == 0).select("row.*")

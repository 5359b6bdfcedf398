"""Language identification by rank-order profiles of character n-grams.

Each language's profile is the list of its most frequent n-grams (1 to ``order`` characters, over all of
its training texts), in order of frequency.  A document's own most frequent n-grams are ranked in the same way and
compared with every profile: each n-gram costs the difference of its two ranks, or ``size`` where the
profile lacks it.  The language of the smallest total distance is predicted; the score is that distance
subtracted from one, relative to the largest possible.

Characters are lower-cased; everything that is no letter separates words, and a word is bounded by one
separator on either side.  Ties in frequency are broken by the n-gram itself, ties in distance by the language's name.

Counts are taken over all training documents: tasks sum up by language and n-gram, Spark adds these, and the profiles
become a table.  Documents are compared with ``at_once`` languages at a time, whose profiles (``size`` n-grams each) are all that
reaches the driver and a broadcast; with more languages the least distance so far goes along to the next block.

Defined cases: a null text, or one without letters, is ``und`` with score 0, as is any text if nothing
was learned; rows of null language teach nothing; repeated rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import text as tx
from clusterlens.llm.staging import column, free_name, stage

ORDER, SIZE, AT_ONCE = 3, 400, 1000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """Codes of all n-grams of a text: up to three characters of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kept = _letters()[points]
    points = np.where(kept, points, np.uint64(32))
    # One separator between words, one at either end.
    gap = np.concatenate([[True], ~kept, [True]])
    points = np.concatenate([[np.uint64(32)], points, [np.uint64(32)]])
    points = points[~(gap & np.concatenate([[False], gap[:-1]]))]
    found = [points[points != 32]]
    if not len(found[0]):
        return found[0]
    code = points
    for _ in range(1, order):
        code = (code[:-1] << np.uint64(21)) | points[len(points) - len(code) + 1 :]
        found.append(code)
    return np.concatenate(found)


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and their counts."""
    codes = np.sort(codes)
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.diff(np.append(heads, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.argsort(-counts, kind="stable")][:size]


def learn_table(documents: DataFrame, text: str = "text", lang: str = "lang", *, order: int = ORDER, size: int = SIZE) -> DataFrame:
    """The profiles of all languages as a table: ``lang, rank`` (from 1) and ``code`` of each n-gram."""
    if not 1 <= order <= 3:
        raise ValueError("n-grams of one to three characters are supported")
    rows = documents.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            held = 0

            def sums() -> pa.RecordBatch:
                names, codes, counts = [], [], []
                for name, parts in by_lang.items():
                    code, count = _added(parts)
                    names += [name] * len(code)
                    codes.append(code.view(np.int64))
                    counts.append(count)
                empty = np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(np.concatenate([empty, *codes])), pa.array(np.concatenate([empty, *counts]))],
                    names=["lang", "code", "n"],
                )

            for value, name in zip(batch.column(0), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(counted(grams(value.as_py(), order)))
                held += len(by_lang[name][-1][0])
                if held > 1 << 21:
                    for other, parts in by_lang.items():
                        by_lang[other] = [_added(parts)]
                    held = sum(len(parts[0][0]) for parts in by_lang.values())
                    if held > 1 << 20:
                        yield sums()
                        by_lang, held = {}, 0
            yield sums()

    counts = rows.mapInArrow(tx.frugal(run), "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= size)
    return stage(best.select("lang", "rank", "code"), "language-profiles")


def learn(documents: DataFrame, text: str = "text", lang: str = "lang", *, order: int = ORDER, size: int = SIZE, max_languages: int = AT_ONCE) -> dict[str, np.ndarray]:
    """The profiles on the driver; raises for more than ``max_languages`` of them, which ``learn_table`` takes."""
    found = blocks(learn_table(documents, text, lang, order=order, size=size), max_languages)
    first = next(found, {})
    if next(found, None):
        raise ValueError(f"over {max_languages} languages; use learn_table")
    return first


def blocks(profiles: DataFrame, at_once: int) -> Iterator[dict[str, np.ndarray]]:
    """The profiles of ``at_once`` languages after another, in order of their names."""
    rest = profiles
    while names := [r.lang for r in rest.select("lang").distinct().orderBy("lang").limit(at_once).collect()]:
        rows = rest.where(F.col("lang") <= names[-1]).orderBy("lang", "rank").toArrow()
        langs, codes = rows.column("lang").to_pylist(), rows.column("code").to_numpy()
        cuts = [0, *(k for k in range(1, len(langs)) if langs[k] != langs[k - 1]), len(langs)]
        yield {langs[a]: codes[a:b].astype(np.int64).view(np.uint64) for a, b in zip(cuts, cuts[1:])}
        rest = rest.where(F.col("lang") > names[-1])


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order].astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[heads], np.add.reduceat(counts, heads) if len(heads) else counts


class Profiles:
    """All profiles as one table of ranks."""

    def __init__(self, profiles: dict[str, np.ndarray], order: int, size: int) -> None:
        self.names, self.order, self.size = sorted(profiles), order, size
        self.codes = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)  # the last row: in no profile
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text or "", self.order)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = top(*counted(codes), self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rows = self.ranks[np.where(self.codes[at] == own, at, len(self.codes))]
        distance = np.where(rows < 0, self.size, np.abs(rows - np.arange(len(own), dtype=np.int32)[:, None])).sum(axis=0)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(own))


def identify(
    documents: DataFrame, profiles: DataFrame | Mapping[str, np.ndarray], *, text: str = "text", order: int = ORDER, size: int = SIZE, at_once: int = AT_ONCE
) -> DataFrame:
    """The documents without the text, with ``lang_pred`` and ``score`` (0 to 1); columns of those names are replaced.

    ``profiles``: what ``learn_table`` or ``learn`` found.  With more than ``at_once`` languages in the table, the
    documents are written to the shared folder between two blocks of languages.
    """
    parts = iter([profiles]) if isinstance(profiles, Mapping) else blocks(profiles, at_once)
    now, following = next(parts, {}), next(parts, None)
    carried = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    held = free_name("text", [*carried, "lang_pred", "score"])
    rows = documents.select(*[column(c) for c in carried], column(text).alias(held))
    found = _compared(rows, now, held, order, size, first=True, last=following is None)
    while following is not None:
        now, following = following, next(parts, None)
        found = _compared(stage(found, "language"), now, held, order, size, first=False, last=following is None)
    return found


def _compared(documents: DataFrame, profiles: Mapping[str, np.ndarray], text: str, order: int, size: int, *, first: bool, last: bool) -> DataFrame:
    """The best language so far: of these profiles, or the one found before if none of these is nearer."""
    table = documents.sparkSession.sparkContext.broadcast(Profiles(dict(profiles), order, size))  # at most size * at_once n-grams
    carried = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    fields = [*[documents.schema[c] for c in carried], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields if last else [*fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index
            found = [table.value.predict(x.as_py()) for x in batch.column(at(text))]
            if not first:
                before = zip(batch.column(at("lang_pred")).to_pylist(), batch.column(at("score")).to_pylist())
                found = [new if new[1] > old[1] else old for old, new in zip(before, found)]
            columns = [*[batch.column(at(c)) for c in carried], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns if last else [*columns, batch.column(at(text))], names=schema.names)

    return documents.mapInArrow(tx.frugal(run), schema)


def fold(doc_id: Column, parts: int) -> Column:
    """Which of ``parts`` folds a document is in, from the CRC of its id as text."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts))

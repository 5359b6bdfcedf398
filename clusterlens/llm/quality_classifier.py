"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Every text becomes a short vector of transformed statistics (sizes, shares of character classes, repetition, word
variety).  The training rows are reduced to counts, sums and sums of products per class, which are
added up by Spark, so the fit covers all labelled rows and only a fixed-size table reaches the driver.
Each class covariance is shrunk towards the pooled one and a multiple of the unit matrix; its Cholesky
factor is inverted once and shipped with the model.  A document's score is the logistic function of the difference of the
two log-densities (Mahalanobis distance and log-determinant) plus the log of the class sizes.

Defined cases: an empty or null text is scored from its (zero) statistics; labels that are null or neither 0
nor 1 teach nothing; labels of unknown documents are ignored, repeated ones count again; if a class has fewer than two
rows, every score is the share of class 1 (0.5 if nothing is labelled).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.llm import text as tx
from clusterlens.llm.staging import stage


def _set(characters: str) -> np.ndarray:
    return np.array([chr(b) in characters for b in range(256)])


_CLASSES = {
    "symbols": _set("#*$%&|<>"),
    "upper": np.array([0x41 <= b <= 0x5A for b in range(256)]),
    "digits": np.array([0x30 <= b <= 0x39 for b in range(256)]),
    "stops": _set(".,;:"),
    "calls": _set("!?"),
    "lines": _set("\n"),
}
FEATURES = ("log_words", "mean_length", "length_spread", "variety", "top_word", "entropy", "repeated_lines", *_CLASSES)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of :data:`FEATURES` for each text."""
    n = len(offsets) - 1
    doc_bytes = np.diff(offsets)
    starts, ends, before = tx.words(data, offsets, tx.NOT_SPACE)
    count = np.diff(before)
    per_word = np.maximum(count, 1)
    hashes = tx.Hashes(tx.VALUES[data])

    def total(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[cut])

    sizes = (ends - starts).astype(np.float64)
    mean = total(sizes, before) / per_word
    spread = np.sqrt(np.maximum(total(sizes**2, before) / per_word - mean**2, 0))
    variety, top, entropy = _variety(hashes.of(starts, ends), np.repeat(np.arange(n), count), n, per_word)
    # Lines: equal non-empty ones beyond the first.
    newline = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1][doc_bytes > 0], newline + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_starts = np.unique(line_starts)
    line_ends = np.append(line_starts[1:], len(data))
    doc = np.searchsorted(offsets, line_starts, side="right") - 1
    at_newline = (data[line_ends - 1] == 10) if len(data) else np.zeros(0, bool)
    line_hash = hashes.of(line_starts, line_ends - at_newline) if len(line_starts) else np.zeros(0, np.uint64)
    some = line_ends - at_newline > line_starts
    doc, line_hash = doc[some], line_hash[some]
    lines = np.bincount(doc, minlength=n)
    order = np.lexsort((line_hash, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (line_hash[order][1:] == line_hash[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    repeated = np.bincount(doc[order][again], minlength=n) / np.maximum(lines, 1)
    share = [np.log(total(inside[data].astype(np.int64), offsets) / np.maximum(doc_bytes, 1) + 1e-3) for inside in _CLASSES.values()]
    columns = [np.log1p(count), np.log1p(mean), np.log1p(spread), variety, np.log(top + 1e-3), entropy, np.sqrt(repeated), *share]
    return np.stack(columns, axis=1).astype(np.float64)


def _variety(words: np.ndarray, doc: np.ndarray, n: int, per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words per word, share of the most frequent one, and entropy per possible entropy."""
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])) if len(words) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(words)))
    owner = doc[heads]
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    p = times / per_word[owner]
    entropy = np.bincount(owner, weights=-p * np.log(p), minlength=n) / np.log(np.maximum(per_word, 2))
    return np.bincount(owner, minlength=n) / per_word, top / per_word, entropy


def with_statistics(documents: DataFrame, text: str = "text", name: str = "features") -> DataFrame:
    """The documents without the text, with their statistics as an array (a column of that name is replaced)."""
    carried = [c for c in documents.columns if c not in (text, name)]
    schema = T.StructType([*[documents.schema[c] for c in carried], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            parts = [statistics(data, offsets) for _, _, data, offsets in tx.pieces(batch.column(names.index(text)))]
            flat = np.concatenate([np.zeros((0, len(FEATURES))), *parts]).ravel()
            array = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in carried], array], names=schema.names)

    return documents.mapInArrow(tx.frugal(run), schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    """Log-prior, mean, inverse Cholesky factor and log-determinant per class; ``flat`` if there is no model."""

    parts: list[tuple[float, np.ndarray, np.ndarray, float]]
    flat: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.flat)
        log_density = []
        for prior, mean, inverse, log_det in self.parts:
            distance = (((x - mean) @ inverse.T) ** 2).sum(axis=1)
            log_density.append(prior - 0.5 * (distance + log_det))
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -500, 500)))


def fit(rows: DataFrame, *, features: str = "features", label: str = "label", towards_pooled: float = 0.1, towards_unit: float = 0.01) -> Model:
    """Fit to all rows whose label is 0 or 1."""
    d = len(FEATURES)
    size = 1 + d + d * d
    rows = rows.where(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("label"), F.col(features).alias("features"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for batch in batches:
            labels, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in (0, 1):
                own = x[labels == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        kinds, places = np.divmod(np.arange(2 * size), size)
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(places, pa.int32()), pa.array(sums.ravel())], names=["c", "place", "value"])

    sums = np.zeros((2, size))
    for row in rows.mapInArrow(tx.frugal(run), "c int, place int, value double").groupBy("c", "place").agg(F.sum("value").alias("value")).collect():
        sums[row.c, row.place] = row.value
    counts = sums[:, 0]
    if counts.min() < 2:
        return Model([], float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = sums[:, 1 : 1 + d] / counts[:, None]
    scatter = [sums[c, 1 + d :].reshape(d, d) - counts[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / counts.sum()
    unit = np.diag(np.maximum(np.diag(pooled), 1e-6))
    parts = []
    for c in (0, 1):
        covariance = (1 - towards_pooled) * scatter[c] / counts[c] + towards_pooled * pooled
        lower = np.linalg.cholesky((1 - towards_unit) * covariance + towards_unit * unit)
        parts.append((float(np.log(counts[c] / counts.sum())), means[c], np.linalg.inv(lower), float(2 * np.log(np.diag(lower)).sum())))
    return Model(parts)


def score(rows: DataFrame, model: Model, *, features: str = "features") -> DataFrame:
    """The rows without the features, with ``score`` (0 to 1) and ``predicted`` (columns of those names are replaced)."""
    carried = [c for c in rows.columns if c not in (features, "score", "predicted")]
    schema = T.StructType([*[rows.schema[c] for c in carried], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            found = model.score(_matrix(batch.column(names.index(features))))
            columns = [batch.column(names.index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=schema.names)

    return rows.mapInArrow(tx.frugal(run), schema)


def classify(documents: DataFrame, labels: DataFrame, learn_from: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Per document: id, ``learnt`` (``learn_from`` held), ``score`` and ``predicted``.

    ``learn_from`` is a condition on ``doc_id``; only labels of documents that meet it are used.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("learnt", F.coalesce(learn_from, F.lit(False)))
    rows = stage(with_statistics(rows), "quality-classifier")
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label"))
    model = fit(rows.where("learnt").join(known, "doc_id").select("label", "features"))
    return score(rows, model)

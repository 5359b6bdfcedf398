"""Toxicity: cumulative-link ordinal regression of severity grades on sparse word features.

A document's features are its lower-cased words, hashed to ``2^bits`` columns, with the logarithm of
one plus their count.  The model has one weight per column and ordered thresholds: the probability of a grade above k is
the logistic function of (weights . features - threshold k), so all thresholds share the weights.  The severity is the
expected grade, the sum of these probabilities.

Labels of more than two grades are used as they are.  From labels 0 and 1 three grades are made: documents
labelled 1 are divided at the median number of their marker words (the columns that
most distinguish the labels) into grades 1 and 2.

The model is fitted on at most ``sample`` labelled rows, those of the smallest hash of the document id; the bound keeps
the broadcast of the sample's ids small.  Spark counts their words and chooses at most ``columns`` of them, and only
these reach the driver.  All documents are scored, over their whole texts.

Defined cases: a null or empty text has no features and gets the severity of an empty text; null labels are ignored;
with labels of one grade only, or none, that grade (0) is everyone's severity; repeated rows are scored alike.
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


LEAST_Z = 3.0  # columns that distinguish the labels less clearly are noise


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, column and count of every word that occurs in a text; sorted by text and column."""
    low = tx.LOWER[data]
    starts, ends, before = tx.words(low, offsets, tx.ALPHANUMERIC)
    column = (tx.Hashes(tx.VALUES[low]).of(starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    code = np.sort((doc << bits) | column)
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[heads] >> bits, code[heads] & ((1 << bits) - 1), np.diff(np.append(heads, len(code)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Model:
    """Weights of the columns kept, and the thresholds (none: every severity is ``flat``)."""

    columns: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int
    flat: float = 0.0

    def above(self, doc: np.ndarray, column: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """Probability of a grade above each threshold, one row per text."""
        at = np.minimum(np.searchsorted(self.columns, column), max(len(self.columns) - 1, 0))
        known = self.columns[at] == column if len(self.columns) else np.zeros(len(column), bool)
        sums = np.bincount(doc[known], weights=self.weights[at[known]] * np.log1p(count[known]), minlength=n)
        return _sigmoid(sums[:, None] - self.thresholds)


def select(doc: np.ndarray, column: np.ndarray, positive: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns whose share among positive texts differs most from that among the others, and the z-score of it."""
    columns, inverse = np.unique(column, return_inverse=True)
    one = np.bincount(inverse, weights=positive[doc])
    all_ = np.bincount(inverse)
    n1, n0 = positive.sum(), len(positive) - positive.sum()
    zero = all_ - one
    pooled = all_ / (n1 + n0)
    z = (one / n1 - zero / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / n1 + 1 / n0))
    z[all_ < 3] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    best = np.sort(best[np.abs(z[best]) >= LEAST_Z])
    return columns[best], z[best]


def grades_of(label: np.ndarray, doc: np.ndarray, column: np.ndarray, count: np.ndarray, columns: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Three grades from two: positive texts are divided at the median count of marker words."""
    strong = columns[z >= max(3.0, float(z.max(initial=0)) / 3)]
    mark = np.isin(column, strong)
    markers = np.bincount(doc[mark], weights=count[mark], minlength=len(label))
    grade = (label > 0).astype(np.int64)
    if (label > 0).any():
        grade[(label > 0) & (markers > np.median(markers[label > 0]))] = 2
    return grade


def fit(label: np.ndarray, doc: np.ndarray, column: np.ndarray, count: np.ndarray, *, bits: int, columns: int = 2000, penalty: float = 2e-5, steps: int = 400) -> Model:
    """Fit by Adam on the mean log-likelihood with a ridge penalty."""
    none = np.zeros(0)
    if len(np.unique(label)) < 2:
        return Model(none.astype(np.int64), none, none, bits, float(label[0]) if len(label) else 0.0)
    chosen, z = select(doc, column, (label > label.min()).astype(np.float64), columns)
    grade = np.unique(label, return_inverse=True)[1]
    if grade.max() == 1:
        grade = np.unique(grades_of(grade, doc, column, count, chosen, z), return_inverse=True)[1]
    at = np.minimum(np.searchsorted(chosen, column), max(len(chosen) - 1, 0))
    known = chosen[at] == column if len(chosen) else np.zeros(len(column), bool)
    row, place, value = doc[known], at[known], np.log1p(count[known])
    n, top = len(label), int(grade.max())
    share = np.clip([(grade > k).mean() for k in range(top)], 1e-6, 1 - 1e-6)
    start = -np.log(share / (1 - share))
    # Thresholds: the first, and the logarithms of the steps between them.
    p = np.concatenate([np.zeros(len(chosen)), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    w = len(chosen)
    for step in range(1, steps + 1):
        thresholds = np.cumsum(np.concatenate([p[w : w + 1], np.exp(p[w + 1 :])]))
        sums = np.bincount(row, weights=p[place] * value, minlength=n)
        above = np.column_stack([np.ones(n), _sigmoid(sums[:, None] - thresholds), np.zeros(n)])
        slope = above * (1 - above)
        likely = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-12)
        upper, lower = slope[np.arange(n), grade] / likely, slope[np.arange(n), grade + 1] / likely
        d_sum = -(upper - lower) / n
        d_threshold = np.zeros(top + 1)
        np.add.at(d_threshold, grade, upper / n)
        inner = grade < top
        np.add.at(d_threshold, grade[inner] + 1, -lower[inner] / n)
        d_threshold = d_threshold[1:]  # above 0 is certain, it has no threshold
        tail = np.cumsum(d_threshold[::-1])[::-1]
        g = np.concatenate([np.bincount(place, weights=d_sum[row] * value, minlength=w) + penalty * p[:w], tail[:1], tail[1:] * np.exp(p[w + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(chosen, p[:w], np.cumsum(np.concatenate([p[w : w + 1], np.exp(p[w + 1 :])])), bits)


def learn(
    documents: DataFrame, labels: DataFrame, learn_from: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 20_000, bits: int = 20, columns: int = 2000
) -> Model:
    """Fit to at most ``sample`` of the labelled documents that meet ``learn_from`` (a condition on ``doc_id``).

    The sample goes by a hash of the id; rows equal in id, text and label count once.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label is not null").where(learn_from)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("copy"))
    # An id may stand in any number of rows: what is learned from is bounded after the join.
    one = ["doc_id", "label", "copy"]
    labelled = texts.select("doc_id", "copy").join(F.broadcast(chosen), "doc_id").select(*one).distinct()
    taken = stage(labelled.orderBy(F.xxhash64("doc_id"), *one).limit(sample), "toxicity-sample")
    rows = texts.join(F.broadcast(taken), ["doc_id", "copy"]).groupBy(*one).agg(F.min("text").alias("text")).select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_ = batch.column(0).to_numpy()
            for first, last, data, offsets in tx.pieces(batch.column(1)):
                doc, column, count = features(data, offsets, bits)
                cut = np.searchsorted(doc, np.arange(last - first + 1)).astype(np.int32)
                found = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (column, count)]
                yield pa.RecordBatch.from_arrays([pa.array(labels_[first:last]), *found], names=["label", "columns", "counts"])

    held = stage(rows.mapInArrow(tx.frugal(run), "label int, columns array<int>, counts array<int>").withColumn("row", F.monotonically_increasing_id()), "toxicity")
    # Only the columns that distinguish the labels come to the driver, however long the texts are.
    known = held.select("row", "label").toArrow()
    order = np.argsort(known.column("row").to_numpy())
    ids, values = known.column("row").to_numpy()[order], known.column("label").to_numpy()[order].astype(np.int64)
    least = int(values.min()) if len(values) else 0
    n1 = int((values > least).sum())
    n0 = len(values) - n1
    none = np.zeros(0, np.int64)
    if not n1:
        return fit(values, none, none, none, bits=bits)
    words = held.select("row", "label", F.explode(F.arrays_zip("columns", "counts")).alias("w")).select("row", "label", F.col("w.columns").alias("column"), F.col("w.counts").alias("count"))
    counts = words.groupBy("column").agg(F.sum((F.col("label") > least).cast("double")).alias("one"), F.count("*").alias("all"))
    share = F.col("all") / (n1 + n0)
    z = F.abs(F.col("one") / n1 - (F.col("all") - F.col("one")) / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    chosen = counts.withColumn("z", z).where((F.col("all") >= 3) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "column").limit(columns).select("column")
    table = words.join(F.broadcast(chosen), "column").select("row", "column", "count").toArrow()
    doc, column, count = (table.column(c).to_numpy() for c in ("row", "column", "count"))
    return fit(values, np.searchsorted(ids, doc), column.astype(np.int64), count.astype(np.int64), bits=bits, columns=columns)


def score(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents without the text, with ``severity``, ``p_toxic``, ``grade`` and ``toxic`` (columns of those names are replaced).

    ``p_toxic`` is the probability of a grade above 0, ``grade`` the most likely grade.
    """
    new = ("severity", "p_toxic", "grade", "toxic")
    carried = [c for c in documents.columns if c not in (text, *new)]
    kinds = (T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType())
    schema = T.StructType([*[documents.schema[c] for c in carried], *[T.StructField(c, kind) for c, kind in zip(new, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            severity, p_toxic, grade = [np.zeros(0)], [np.zeros(0)], [np.zeros(0, np.int32)]
            for first, last, data, offsets in tx.pieces(batch.column(names.index(text))):
                n = last - first
                if not len(model.thresholds):
                    severity.append(np.full(n, model.flat))
                    p_toxic.append(np.full(n, float(model.flat > 0)))
                    grade.append(np.full(n, int(model.flat), np.int32))
                    continue
                above = model.above(*features(data, offsets, model.bits), n)
                severity.append(above.sum(axis=1))
                p_toxic.append(above[:, 0])
                each = -np.diff(np.column_stack([np.ones(n), above, np.zeros(n)]), axis=1)
                grade.append(each.argmax(axis=1).astype(np.int32))
            p = np.concatenate(p_toxic)
            found = [pa.array(np.concatenate(severity)), pa.array(p), pa.array(np.concatenate(grade)), pa.array(p >= 0.5)]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in carried], *found], names=schema.names)

    return documents.mapInArrow(tx.frugal(run), schema)

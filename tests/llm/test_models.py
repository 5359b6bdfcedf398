"""Language, quality and toxicity models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import language, quality_classifier, toxicity
from hard_documents import hard_rows


def plain_predict(text, profiles, size):
    padded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i : i + n]
            if gram != " ":
                counts[gram] = counts.get(gram, 0) + 1

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    own = sorted((code(g) for g in counts), key=lambda c: (-next(n for g, n in counts.items() if code(g) == c), c))[:size]
    distances = {}
    for lang, profile in profiles.items():
        ranks = {int(c): k for k, c in enumerate(profile)}
        distances[lang] = sum(abs(ranks[c] - k) if c in ranks else size for k, c in enumerate(own))
    best = min(sorted(distances), key=lambda k: distances[k])
    return best, 1 - distances[best] / (size * len(own))


def test_language_against_plain_ranks(spark, data):
    documents = data("documents")
    profiles = language.learn(documents, size=120)
    assert set(profiles) == {"de", "en", "es", "fr"} and all(len(p) == 120 for p in profiles.values())
    texts = {r.doc_id: r.text for r in documents.limit(12).collect()}
    found = language.identify(documents.limit(12).select("doc_id", "text"), profiles, size=120).collect()
    for row in found:
        lang, score = plain_predict(texts[row.doc_id], profiles, 120)
        assert row.lang_pred == lang and row.score == pytest.approx(score)


def test_language_held_out_accuracy(data):
    documents = data("documents")
    held_out = language.fold(F.col("doc_id"), 5) == 0
    found = language.identify(documents.where(held_out), language.learn(documents.where(~held_out)))
    right = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.95


def test_language_hard_rows(hard, none):
    profiles = language.learn(hard.where("lang is not null"))
    found = language.identify(hard, profiles)
    rows = found.collect()
    assert len(rows) == len(hard_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert {r.lang_pred for r in language.identify(hard, language.learn(none)).collect()} == {"und"}
    assert language.identify(none, profiles).count() == 0
    with pytest.raises(ValueError):
        language.learn(hard, max_languages=1)


def test_languages_in_blocks(spark, data, hard, none):
    documents = data("documents").select("doc_id", "text", F.concat("lang", F.pmod("doc_id", F.lit(3)).cast("string")).alias("lang"))
    table = language.learn_table(documents)
    rows = documents.select("doc_id", "text", F.lit(5).alias("score")).union(hard.select(F.col("doc_id") + 10**6, "text", F.lit(5)))
    whole = sorted(language.identify(rows, table).collect(), key=repr)
    assert len({r.lang_pred for r in whole}) > 5
    for at_once in (1, 5):
        assert sorted(language.identify(rows, table, at_once=at_once).collect(), key=repr) == whole
    assert [len(b) for b in language.blocks(table, 5)] == [5, 5, 2]
    assert {r.lang_pred for r in language.identify(hard, language.learn_table(none)).collect()} == {"und"}


def test_quality_statistics_of_single_texts_and_together():
    from clusterlens.llm.text import pieces
    import pyarrow as pa

    texts = [r[1] for r in hard_rows()]
    (_, _, data, offsets), *_ = pieces(pa.array(texts), 1 << 30)
    together = quality_classifier.statistics(data, offsets)
    for text, row in zip(texts, together):
        (_, _, own, cut), *_ = pieces(pa.array([text], pa.string()))
        assert np.allclose(quality_classifier.statistics(own, cut)[0], row)
    words = texts[0].split()
    assert together[0][0] == pytest.approx(np.log1p(len(words)))
    assert together[0][3] == pytest.approx(len(set(words)) / len(words))


def test_quality_model_against_plain_densities(spark):
    pick = np.random.default_rng(0)
    d = len(quality_classifier.FEATURES)
    labels = pick.integers(0, 2, 400)
    x = pick.normal(size=(400, d)) * (1 + labels[:, None]) + labels[:, None]
    rows = spark.createDataFrame([(int(y), v.tolist()) for y, v in zip(labels, x)], "label int, features array<double>").repartition(4)
    model = quality_classifier.fit(rows)
    pooled = sum(np.cov(x[labels == c].T, bias=True) * (labels == c).sum() for c in (0, 1)) / 400
    density = []
    for c in (0, 1):
        covariance = 0.9 * np.cov(x[labels == c].T, bias=True) + 0.1 * pooled
        covariance = 0.99 * covariance + 0.01 * np.diag(np.diag(pooled))
        gap = x - x[labels == c].mean(axis=0)
        distance = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(covariance), gap)
        density.append(np.log((labels == c).mean()) - 0.5 * (distance + np.linalg.slogdet(covariance)[1]))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(density[0] - density[1])))


def area(label, score):
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(1, len(score) + 1)
    one = label == 1
    return (ranks[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    found = quality_classifier.classify(documents, labels, language.fold(F.col("doc_id"), 3) != 1)
    rows = found.where("not learnt").join(labels, "doc_id").toPandas()
    assert area(rows.quality.to_numpy(), rows.score.to_numpy()) > 0.95


def test_quality_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (7, 1), (14, 0), (15, 0), (15, None), (99, 1), (8, 5)], "doc_id bigint, quality int")
    rows = quality_classifier.classify(hard, labels, F.col("doc_id") > 0).collect()
    assert len(rows) == len(hard_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.score for r in quality_classifier.classify(hard, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_classifier.classify(none, labels, F.lit(True)).count() == 0


def test_toxicity_gradient_and_order():
    pick = np.random.default_rng(1)
    n, bits = 600, 10
    grade = pick.integers(0, 4, n)
    doc, column, count = [], [], []
    for k in range(n):
        counts = {int(c): 1 for c in pick.integers(100, 400, 20)}
        for _ in range(int(grade[k]) * 2):
            c = int(pick.integers(0, 5))
            counts[c] = counts.get(c, 0) + 1
        for c in sorted(counts):
            doc.append(k), column.append(c), count.append(counts[c])
    doc, column, count = (np.array(x) for x in (doc, column, count))
    model = toxicity.fit(grade, doc, column, count, bits=bits)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    severity = model.above(doc, column, count, n).sum(axis=1)
    means = [severity[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and np.corrcoef(severity, grade)[0, 1] > 0.9


def test_toxicity_of_planted_words(spark):
    pick = random.Random(5)
    bad = ["zyx", "qwv", "vvk"]
    rows, labels = [], []
    for k in range(500):
        words = [f"w{pick.randrange(300)}" for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(pick.randrange(1, 6)):
                words[pick.randrange(40)] = pick.choice(bad).upper() + "!"
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.learn(documents, spark.createDataFrame(labels, "doc_id bigint, toxic int"), F.col("doc_id") < 400)
    found = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    assert all(found[k].toxic == (k % 5 == 0) for k in range(400, 500))
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 for r in found.values())


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    sizes = []
    fit = toxicity.fit

    def seen(label, *rest, **named):
        sizes.append(len(label))
        return fit(label, *rest, **named)

    monkeypatch.setattr(toxicity, "fit", seen)
    rows = [(k, f"word{k % 7} bad{k % 2}") for k in range(30)] + [(3, f"text {k}") for k in range(500)] + [(4, "same")] * 300
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, toxic int")
    toxicity.learn(documents, labels, F.lit(True), sample=20)
    toxicity.learn(documents, labels, F.lit(True), sample=30)
    toxicity.learn(documents, labels, F.lit(True))
    assert sizes[0] <= 20 and sizes[1] == 30 and sizes[2] == 531


def test_toxicity_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (7, 0), (8, 1), (13, 0), (99, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(hard, labels, F.lit(True))
    rows = toxicity.score(hard, model).collect()
    assert len(rows) == len(hard_rows())
    assert len({r.severity for r in rows if r.doc_id in (4, 5, 6)}) == 1
    alone = toxicity.learn(hard, labels.where("toxic = 0"), F.lit(True))
    assert {r.severity for r in toxicity.score(hard, alone).collect()} == {0.0}
    assert {r.severity for r in toxicity.score(hard, toxicity.learn(hard, labels.limit(0), F.lit(True))).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0

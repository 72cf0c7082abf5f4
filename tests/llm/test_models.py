"""Toxicity and line quality: held-out accuracy, gradients, hard inputs."""

import random

import numpy as np
import pytest

from timelore.llm import quality_crf, toxicity
from timelore.llm.common import table
from tests.llm.conftest import words

SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / n / (len(label) - n)


def test_thresholds_share_weights_and_order():
    rng = np.random.default_rng(0)
    n, d = 1500, 12
    x = (rng.random((n, d)) < 0.3) * 1.0
    true = np.array([2.0, -1.5, 1.0, 0.5] + [0.0] * (d - 4))
    level = x @ true + rng.logistic(size=n)
    grades = np.searchsorted([0.5, 1.5, 3.0], level)
    owner, at = np.nonzero(x)
    weights, thresholds = toxicity.fit_ordinal(owner, at, x[owner, at], grades, d)
    assert (np.diff(thresholds) > 0).all() and np.abs(weights - true).max() < 0.45
    assert np.abs(thresholds - [0.5, 1.5, 3.0]).max() < 0.5


def test_toxicity_on_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in toxicity.fit_and_score(docs, labels).collect()}
    marks = labels.collect()
    assert len(got) == docs.count()
    assert auc(np.array([got[r.doc_id].score for r in marks]), np.array([r.toxic for r in marks])) > 0.98
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in marks]) > 0.97
    assert all(0 <= r.expected_severity <= 3 and r.expected_severity >= r.score - 1e-9 for r in got.values())


def test_severity_fit_is_a_best_point_of_the_likelihood():
    """Against the likelihood written out row by row: no small change of a weight or threshold makes it better."""
    rng = np.random.default_rng(2)
    n, words_ = 400, 5
    x = rng.poisson(0.7, (n, words_)).astype(float)
    level = x @ np.array([1.2, -0.8, 0.5, 0.0, 0.9])
    grades = (level[:, None] + rng.logistic(size=(n, 1)) > np.array([0.5, 1.5, 3.0])[None]).sum(axis=1)
    owner, at = np.nonzero(x)

    def loss(w, theta):
        total = 0.0
        for i in range(n):
            ge = [1.0, *[1 / (1 + np.exp(t - x[i] @ w)) for t in theta], 0.0]
            total -= np.log(ge[grades[i]] - ge[grades[i] + 1])
        return total / n + 0.02 / words_ * (w @ w) / 2

    w, theta = toxicity.fit_ordinal(owner, at, x[owner, at], grades, words_, steps=1_500, rate=0.02)
    best = loss(w, theta)
    assert (np.diff(theta) > 0).all() and np.allclose(w, [1.2, -0.8, 0.5, 0.0, 0.9], atol=0.35)
    for k in range(words_ + 3):
        for step in (-0.02, 0.02):
            moved = np.concatenate([w, theta])
            moved[k] += step
            assert loss(moved[:words_], moved[words_:]) > best - 1e-6


def test_toxicity_of_documents_that_were_not_fitted(spark):
    from pyspark.sql import functions as F

    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    held = quality_crf.held_out(F.col("doc_id"))
    model = toxicity.fit(docs, labels.filter(~held))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    marks = labels.filter(held).filter("toxic is not null").collect()
    score, toxic = np.array([got[r.doc_id] for r in marks]), np.array([r.toxic for r in marks])
    assert toxic.sum() > 50 and auc(score, toxic) > 0.95
    assert (score > 0.5)[toxic == 1].mean() > 0.75 and (score > 0.5)[toxic == 0].mean() < 0.01


def test_toxicity_hard_inputs(spark, hard_docs, no_docs):
    marks = spark.createDataFrame([(1, 0, 0), (5, 1, 1), (5, 1, 0), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.fit_and_score(hard_docs, marks).collect()
    assert len(rows) == hard_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit_and_score(no_docs, marks).collect() == []
    assert all(r.score == pytest.approx(0, abs=1e-9) for r in toxicity.fit_and_score(hard_docs, marks.limit(0)).collect())


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 4])
    level, change = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, log_z = quality_crf.forward_backward(level, change, counts)
    at, want_good, want_pair, want_z = 0, [], np.zeros((2, 2)), 0.0
    for n in counts:
        paths = [[(p >> i) & 1 for i in range(n)] for p in range(2**n)]
        w = np.array([np.exp(sum(level[at + i] * y[i] for i in range(n)) + sum(change[y[i], y[i + 1]] for i in range(n - 1))) for y in paths])
        want_z += np.log(w.sum())
        w /= w.sum()
        want_good += [sum(p for p, y in zip(w, paths) if y[i]) for i in range(n)]
        for p, y in zip(w, paths):
            for i in range(n - 1):
                want_pair[y[i], y[i + 1]] += p
        at += n
    assert np.allclose(good, want_good) and np.allclose(pair, want_pair) and np.isclose(log_z, want_z)


def test_lines_see_their_neighbours():
    own, size, counts = quality_crf.line_features(["Good line here.\nBAD!! LINE!!\nlast one", "", None or "x"])
    features = quality_crf.with_neighbours(own, counts)
    assert counts.tolist() == [3, 1, 1] and len(features) == len(size) == 5
    n = quality_crf.N_OWN
    model = quality_crf.LineField(np.random.default_rng(0).normal(size=3 * n), 0.3, np.zeros((2, 2)))
    assert np.allclose(model.marginals(own, counts), 1 / (1 + np.exp(-(features @ model.weights + 0.3))), atol=1e-5)
    assert (features[1, n : 2 * n] == features[0, :n]).all() and (features[1, 2 * n :] == features[2, :n]).all()
    assert not features[0, n : 2 * n].any() and not features[2, 2 * n :].any() and not features[3, n:].any()


def test_blank_texts_alone():
    model = quality_crf.LineField(np.ones(3 * quality_crf.N_OWN), 0.0, np.zeros((2, 2)))
    assert len({*model.scores([""]), *model.scores([" \n\t"]), *model.scores(["", "\n"])}) == 1


def test_quality_on_the_tables(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality_crf.fit_and_score(docs, labels).collect()}
    marks = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert len(got) == docs.count() and len(marks) > 50
    assert auc(np.array([got[r.doc_id].score for r in marks]), np.array([r.quality for r in marks])) > 0.95
    assert np.mean([got[r.doc_id].predicted == r.quality for r in marks]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, SF, "documents").limit(300), table(spark, SF, "labels")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in quality_crf.fit_and_score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_hard_inputs(spark, hard_docs, no_docs):
    rng = random.Random(3)
    more = spark.createDataFrame([(1000 + i, (words(i, 30).upper() + "!! ") * 3 if i % 2 else words(i, 60) + ".\n" + words(i + 500, rng.randint(5, 50))) for i in range(80)], "doc_id long, text string")
    marks = spark.createDataFrame([(1000 + i, 1 - i % 2, 0) for i in range(80)] + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.fit(more, marks)
    rows = quality_crf.score(hard_docs, model).collect()
    assert len(rows) == hard_docs.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality_crf.keep_good(hard_docs, model)
    assert kept.columns == hard_docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality_crf.score(no_docs, model).collect() == [] and quality_crf.keep_good(no_docs, model).collect() == []
    assert {r.score for r in quality_crf.fit_and_score(hard_docs, marks.limit(0)).collect()} == {1.0}

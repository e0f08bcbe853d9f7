"""The ordinal regression's likelihood, gradient, probabilities and features against plain computations."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from marketgrain.llm import toxicity
from marketgrain.llm.toxicity import Design, OrdinalModel, loss_and_gradient


def some_design():
    rng = np.random.default_rng(3)
    dense = rng.random((30, 6)) * (rng.random((30, 6)) < 0.5)
    rows, columns = np.nonzero(dense)
    return dense, Design(rows, columns, dense[rows, columns], 30, 6), rng.integers(0, 4, 30), rng


def test_likelihood_and_gradient():
    dense, design, grade, rng = some_design()
    weights, first, gaps, weight = rng.normal(size=6), 0.3, rng.normal(size=2), rng.random(30)
    loss, by_weight, by_first, by_gaps = loss_and_gradient(weights, first, gaps, design, grade, weight, 2.0)
    cuts = [first, first + math.exp(gaps[0]), first + math.exp(gaps[0]) + math.exp(gaps[1])]
    above = lambda s, k: 1.0 if k < 0 else 0.0 if k > 2 else 1 / (1 + math.exp(cuts[k] - s))
    plain = sum(-w * math.log(above(s, g - 1) - above(s, g)) for s, g, w in zip(dense @ weights, grade, weight)) + (weights**2).sum() / 30
    assert loss == pytest.approx(plain)
    value = lambda w, f, g: loss_and_gradient(w, f, g, design, grade, weight, 2.0)[0]
    step = 1e-6
    for i in range(6):
        up = weights + step * (np.arange(6) == i)
        assert (value(up, first, gaps) - loss) / step == pytest.approx(by_weight[i], abs=1e-4)
    assert (value(weights, first + step, gaps) - loss) / step == pytest.approx(by_first, abs=1e-4)
    for i in range(2):
        assert (value(weights, first, gaps + step * (np.arange(2) == i)) - loss) / step == pytest.approx(by_gaps[i], abs=1e-4)


def test_training_lowers_the_loss_and_orders_thresholds():
    _, design, grade, _ = some_design()
    weights, thresholds = toxicity.train(design, grade, np.ones(30, bool), 3, 1.0)
    assert (np.diff(thresholds) > 0).all()
    weight = np.full(30, 1 / 30)
    start = loss_and_gradient(np.zeros(6), 0.0, np.zeros(2), design, grade, weight, 1.0)[0]
    assert loss_and_gradient(weights, thresholds[0], np.log(np.diff(thresholds)), design, grade, weight, 1.0)[0] < start


def test_features_and_scores(spark):
    texts = ["Réeuxpa réeuxon Réeuxpa, trash!", None, "", "a trashcan of trash", "x" * 5000 + " trash"]
    plain = []
    for text in texts:
        words, found = {w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))}, {}
        for word in words:
            for key in [("word", word), *(("head", word[:n]) for n in (4, 5, 6) if len(word) > n)]:
                found[key] = found.get(key, 0) + 1
        plain.append(sorted(math.log2(1 + n) for n in found.values()))
    text, hashes, values = toxicity._features(pa.array(texts))
    assert [sorted(values[text == i].tolist()) for i in range(len(texts))] == plain
    known = np.unique(hashes)
    weights = np.random.default_rng(1).normal(size=len(known))
    model = OrdinalModel(known, weights, np.array([0.1, 0.5, 2.0]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(frame, model).collect():
        s = sum(weights[np.searchsorted(known, h)] * v for h, v in zip(hashes[text == r.doc_id], values[text == r.doc_id]))
        above = [1 / (1 + math.exp(t - s)) for t in (0.1, 0.5, 2.0)]
        each = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert r.expected_severity == pytest.approx(sum(above)) and r.grade == each.index(max(each)) and r.toxic == (above[0] >= 0.5)


def test_ties_and_odd_labels(spark):
    docs = spark.createDataFrame([(i, "plain words " + ("vile nasty" if i % 2 else "")) for i in range(60)] + [(7, "another text"), (None, "vile nasty")], "doc_id long, text string")
    labels = docs.where("doc_id is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic").unionByName(spark.createDataFrame([(3, 0), (4, None), (999, 1), (None, 1), (5, 7)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.selectExpr("*", "1 AS grade0", "'x' AS toxic_before"), model, carry=("grade0",)).collect()
    assert {(r.doc_id % 2, r.toxic) for r in got if r.doc_id not in (7, None)} == {(0, False), (1, True)}
    assert [r.toxic for r in got if r.doc_id is None] == [True] and all(r.grade0 == 1 for r in got)

"""Operator 11 against comparing everything."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketgrain.llm import mtree

SCHEMA = "vec_id long, embedding array<double>, row string, query int, score string, rank int, u int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "clash", 1, "x", 2, 3) for k, v in rows], SCHEMA)


def by_hand(rows, k, every):
    kept = [(i, key, [math.floor(1024 * c) for c in v]) for i, (key, v) in enumerate(rows) if key is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    found = []
    for i, key, q in kept:
        if key % every == 0:
            scored = sorted(((-sum(a * b for a, b in zip(q, u)), other) for j, other, u in kept if j != i))[:k]
            found += [(key, n + 1, other, -s) for n, (s, other) in enumerate(scored)]
    return sorted(found)


def found(spark, rows, k, every):
    got = mtree.top_k(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0, k)
    return sorted(map(tuple, got.collect()))


def test_random_vectors_with_ties(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD_ROWS", 40)
    monkeypatch.setattr(mtree, "LEAST_SHARDS", 4)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 10)
    rng = random.Random(8)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(3)]) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.25, 0.25]) for i in range(150)]  # copies fill shards of their own
    rows += [(2000 + i, [rng.gauss(0, 30) for _ in range(3)]) for i in range(50)]  # far longer ones
    rng.shuffle(rows)
    assert found(spark, rows, 7, 25) == by_hand(rows, 7, 25)


def test_missing_vectors_and_shared_ids(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (None, [9.0, 9.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, []), (6, [0.1, 0.2]), (10, [-1.0, -1.0])]
    kept = [(k, v) for k, v in rows if v is not None and len(v) == 2]
    assert found(spark, rows, 3, 10) == by_hand(kept, 3, 10)
    assert found(spark, rows, 3, 10)[0][2] == 0  # the other row of its vec_id


def test_few_rows(spark):
    assert found(spark, [], 3, 1) == [] and found(spark, [(1, None)], 3, 1) == []
    assert found(spark, [(1, [1.0])], 3, 1) == []
    assert found(spark, [(1, [0.0]), (2, [0.0])], 3, 1) == [(1, 1, 2, 0), (2, 1, 1, 0)]
    with pytest.raises(Exception, match="2\\*\\*53"):
        found(spark, [(1, [1e9]), (2, [1.0])], 3, 1)


def tree_of(u):
    metric = mtree.Metric(float((u * u).sum(axis=1).max()))
    pages = mtree._pages(u, metric)
    rows, names = [], ["page", "leaf", "centre", "near", "radius", "child", "row", "vec_id", "u"]
    for p in pages:
        own = p["rows"].astype(np.int64)
        rows.append((p["page"], p["leaf"], p["centre"].astype(np.int32).tobytes(), p["near"].tobytes(), p["radius"].tobytes(), p["child"].tobytes(), own.tobytes(), own.tobytes(), u[own].astype(np.int32).tobytes()))
    return mtree.Tree(pa.table([list(c) for c in zip(*rows)], names), metric)


def test_pages_cover_and_bounds_save_distances():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4000, (40, 4))
    u = np.floor(np.concatenate([c + rng.normal(0, 60, (100, 4)) for c in centres]))
    tree = tree_of(u)
    leaves = [p for p in tree.pages.values() if p["leaf"]]
    assert sorted(np.concatenate([p["row"] for p in leaves]).tolist()) == list(range(len(u)))
    assert max(len(p["row"]) for p in leaves) <= mtree.LEAF and max(len(p["child"]) for p in tree.pages.values()) <= mtree.FANOUT
    for p in tree.pages.values():
        for k, c in enumerate(p["child"].tolist()):
            below, within = [c], []
            while below:
                child = tree.pages[below.pop()]
                below += child["child"].tolist()
                within += child["u"].tolist()
            assert tree.metric.between(np.array(within), tree.pages[c]["centre"][None]).max() <= p["radius"][k] + 1e-3
    for i in range(0, len(u), 200):
        best = mtree.Best(10, -np.inf)
        tree.search(u[i], i, best)
        scores = u @ u[i]
        scores[i] = -np.inf
        assert best.scores.tolist() == sorted(scores, reverse=True)[:10]
    assert tree.computed < 0.3 * len(u) * len(range(0, len(u), 200))


def test_a_floor_keeps_ties():
    u = np.array([[3.0], [2.0], [2.0], [1.0]])
    best = mtree.Best(5, 2.0)
    tree_of(u).search(np.array([1.0]), -1, best)
    assert best.scores.tolist() == [3.0, 2.0, 2.0]

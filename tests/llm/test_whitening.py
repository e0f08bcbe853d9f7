"""Operator 12 against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketgrain.llm import whitening
from marketgrain.llm.queries import QUERIES
from marketgrain.llm.vectors import matrix

SCHEMA = "vec_id long, embedding array<double>, n int, x string, i int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, 1, "clash", 2) for k, v in enumerate(vectors)], SCHEMA)


def fitted_by_hand(vectors):
    kept = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in kept]
    distinct = sorted(set(map(tuple, x)))
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(v, sums)] for v in distinct]
    d = len(sums)
    cov = [[sum(v[i] * v[j] for v in centred) / n for j in range(d)] for i in range(d)]
    return x, distinct, n, sums, cov


def test_query_equals_plain_program(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    e = np.array(table["embedding"].to_pylist())
    x = np.floor(e * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    y = u * n - sums
    values, vectors = np.linalg.eigh((y.T.astype(object) @ y / n**3).astype(float))
    got = QUERIES["op12_whitening"](spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(e) and set(got.n) == {n} and got.identity_error.max() <= 1e-4
    deviation = dict(zip(table["vec_id"].to_pylist(), ((x * n - sums) ** 2).sum(axis=1).tolist()))
    assert all(deviation[k] == d for k, d in zip(got.vec_id, got.deviation))
    want = ((x - sums / n) @ vectors[:, ::-1][:, :16]) / np.sqrt(values[::-1][:16])
    order = np.argsort(table["vec_id"].to_numpy())
    assert np.allclose(np.abs(got.whitened.to_numpy().reshape(-1, 16)), np.abs(want[order]), atol=1e-7)
    assert np.allclose(got.explained.to_numpy()[:16], values[::-1][:16] / values.sum())


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(v) for v in r] for r in rng.normal(0, 3e5, (300, 3))]
    _, distinct, n, sums, cov = fitted_by_hand(vectors)
    rows = frame(spark, vectors + vectors[:7]).repartition(5)
    found = whitening.fit_list(rows, 3)
    known = whitening.totals(found, 3)
    assert (known.n, known.sums) == (n, sums)
    exact = whitening.scatter(found, 3, known)
    assert [[Fraction(v, n**3) for v in row] for row in exact] == cov


@settings(max_examples=60, deadline=None)
@given(st.integers(-(10**30), 10**30))
def test_remaindering(v):
    moduli = whitening.primes(2 * 10**30)
    assert whitening.remaindered([v % p for p in moduli], moduli) == v
    assert all(p < 2**20 for p in moduli) and len(set(moduli)) == len(moduli)


def test_block_sums_stay_exact():
    assert whitening.BLOCK * (2**whitening.PRIME_BITS - 1) ** 2 < 2**53


def test_missing_vectors_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.1, 0.5], None, [None, 0.2], [nan, 0.1], [inf, 0.0], [0.3], [], [0.1, 0.5], [0.9, -0.5], [0.4, 0.45], [-0.2, 0.8]]
    got = whitening.whiten(frame(spark, vectors)).collect()
    assert {r.vec_id for r in got} == {0, 7, 8, 9, 10} and len(got) == 10
    _, distinct, n, sums, _ = fitted_by_hand([vectors[i] for i in (0, 7, 8, 9, 10)])
    assert n == 4 and all(r.n == 4 for r in got)
    by = {(r.vec_id, r.component): r for r in got}
    assert by[0, 1].whitened == by[7, 1].whitened
    assert by[8, 1].deviation == sum((4 * (math.floor(64 * c) + 1_000_000) - s) ** 2 for c, s in zip(vectors[8], sums))
    assert got[0].identity_error < 1e-9 and abs(by[0, 1].explained + by[0, 2].explained - 1) < 1e-12


def test_tables_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [None, [None]])).count() == 0
    one = whitening.whiten(frame(spark, [[0.5, 0.25]] * 3)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in one)
    line = whitening.whiten(frame(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]])).collect()
    assert [r.whitened is None for r in line if r.vec_id == 0] == [False, True]
    assert [r.explained for r in line if r.vec_id == 0] == [1.0, 0.0]


def test_large_numbers(spark):
    wide = [[1e9, 0.0], [-1e9, 1.0], [0.0, 5e8]]
    got = {(r.vec_id, r.component): r for r in whitening.whiten(frame(spark, wide)).collect()}
    x, _, n, sums, _ = fitted_by_hand(wide)
    exact = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert [got[k, 1].deviation for k in range(3)] == [d if d < 2**63 else None for d in exact]
    with pytest.raises(Exception, match="size"):
        whitening.whiten(frame(spark, [[2.0**41, 0.0]])).collect()


def test_matrix_skips_what_is_missing():
    column = pa.array([None, [1.0, 2.0], [1.0], [3.0, None], [5.0, 6.0]], pa.list_(pa.float32()))
    rows, found = matrix(column.slice(1), 2)
    assert rows.tolist() == [0, 3] and found.tolist() == [[1.0, 2.0], [5.0, 6.0]]

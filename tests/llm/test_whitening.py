"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherum.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def rows_of(vectors):
    return [(k, v, 0, "clash", 7) for k, v in enumerate(vectors)]


def plain(vectors, k):
    """(ids, x, n, S, eigenvalues, eigenvectors, trace) by numpy."""
    good = [(i, v) for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good], dtype=np.int64)
    fit = np.array(sorted(set(map(tuple, x.tolist()))))
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    e, u = np.linalg.eigh(cov)
    return [i for i, _ in good], x, len(fit), fit.sum(axis=0), e[::-1][:k], u[:, ::-1][:, :k], np.trace(cov)


def check(spark, vectors, k, d):
    got = {}
    for r in whitening.whiten(spark.createDataFrame(rows_of(vectors), SCHEMA), k=k).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    ids, x, n, sums, e, u, trace = plain(vectors, k)
    assert sorted(got) == ids
    white = (x - sums / n) @ u / np.sqrt(e)
    mine = np.array([[got[i][c + 1].whitened for c in range(k)] for i in ids])
    sign = np.sign((white * mine).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7
    for i, row in zip(ids, x):
        r = got[i][1]
        assert r.n == n and r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums))
        assert r.identity_error < 1e-8 and abs(r.explained - e[0] / trace) < 1e-10


def test_components_and_whitened_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 40)) * np.linspace(1, 3, 40)
    vectors = [[float(c) for c in v] for v in base] + [[float(c) for c in base[0]]] * 200  # copies count once in the fit list
    vectors += [None, [], [None] + [0.0] * 39, [math.nan] + [0.0] * 39, [math.inf] + [0.0] * 39, [0.0] * 40]
    check(spark, vectors, 5, 40)


def test_flat_spectrum_needs_the_filter():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(4000, 200))
    cov = np.cov(rows.T, bias=True)
    e, u, passes = whitening.principal_components(lambda q: cov @ q, 200, 8)
    w, v = np.linalg.eigh(cov)
    assert np.allclose(e, w[::-1][:8], rtol=1e-12) and np.abs(np.abs((u * v[:, ::-1][:, :8]).sum(axis=0)) - 1).max() < 1e-9
    assert passes < 150


def test_awkward_tables(spark):
    make = lambda v: whitening.whiten(spark.createDataFrame(rows_of(v), SCHEMA))
    assert make([]).count() == 0 and make([None, []]).count() == 0
    assert make([[1.0, 2.0]]).count() == 0 and make([[1.0, 2.0]] * 5).count() == 0  # no variance, no component
    line = make([[float(k), 2.0 * k, 0.0] for k in range(10)]).collect()
    assert {r.component for r in line} == {1} and len(line) == 10 and line[0].explained == pytest.approx(1)
    mixed = make([[float(k), float(k * k % 7)] for k in range(9)] + [[1.0]] * 3).collect()
    assert {r.vec_id for r in mixed} == set(range(9))
    big = make([[1e30, 0.0], [-1e30, 1.0], [5.0, 2.0]]).collect()
    assert {r.vec_id: r.deviation for r in big if r.component == 1} == {0: None, 1: None, 2: 446464}
    named = spark.createDataFrame([(None, [0.0, float(k)], k) for k in range(4)], "vec_id long, embedding array<float>, `a.b` int").withColumn("whitened", F.lit("x"))
    assert [r.vec_id for r in whitening.whiten(named).collect()] == [None] * 4

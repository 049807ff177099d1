"""Whitening against a dense eigensolver and exact arithmetic, also on unusable vectors, clashing names and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
RNG = np.random.default_rng(5)


def rows(n=300, dim=7):
    data = (RNG.standard_normal((n, dim)) * np.arange(1, dim + 1)).astype(np.float32)
    found = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    found += [(900, None, 0), (901, [1.0] * (dim - 1) + [None], 0), (902, [math.nan] * dim, 0), (903, [math.inf] * dim, 0), (904, [], 0), (905, [1.0, 2.0], 0), (None, data[3].tolist(), 1), (3, data[3].tolist(), 1), (906, [0.0] * dim, None)]
    return found


def usable(found, dim):
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in found if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


@pytest.mark.parametrize("clash", [False, True])
def test_whitening(spark, clash):
    found = rows()
    frame = spark.createDataFrame(found, SCHEMA).repartition(5)
    if clash:
        frame = frame.withColumns({c: F.lit("clash") for c in ("component", "n", "deviation", "whitened", "place", "x", "line", "term", "dim")})
    got = whitening.whiten(frame, whitening.fit(frame, components=5)).collect()
    own = usable(found, 7)
    n, sums = len(own), [sum(c) for c in zip(*[x for _, x in own], strict=True)]
    x = np.array([v for _, v in own], float)
    y = x - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    whole = y @ vectors / np.sqrt(values)
    assert len(got) == 5 * n
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    for k in range(5):
        sign = np.sign(sum(by[i, k + 1][0].whitened * whole[at, k] for at, (i, _) in enumerate(own)))
        for at, (i, v) in enumerate(own):
            for r in by[i, k + 1]:
                assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
                assert r.whitened == pytest.approx(sign * whole[at, k], abs=1e-9)
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10) and 0 <= r.identity_error < 1e-10


def test_no_vectors_or_none_that_vary(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty, whitening.fit(empty)).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(4)], SCHEMA)
    assert whitening.whiten(same, whitening.fit(same)).collect() == []  # no component has a variance


def test_deviations_that_leave_64_bits():
    model = whitening.Whitening(10**9, [10**15, 0], np.array([1e6, 0]), np.zeros(2), np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(np.array([[1e6 + 3, 1.0], [1e6 + 9, 0.0]])) == [None, None]
    assert model.deviations(np.array([[1e6 + 1, 1.0]])) == [2 * 10**18]


MATRICES = {
    "random": np.cov(RNG.standard_normal((64, 4000))),
    "of low rank": (lambda g: g @ g.T)(RNG.standard_normal((20, 5))),
    "identity": 3 * np.eye(9),
    "zero": np.zeros((4, 4)),
    "of equal eigenvalues": np.diag([5.0, 5, 5, 2, 2, 1]),
    "graded": (lambda q: q @ np.diag(10.0 ** -np.arange(12)) @ q.T)(np.linalg.qr(RNG.standard_normal((12, 12)))[0]),
    "one": np.array([[4.0]]),
}


@pytest.mark.parametrize("name", MATRICES)
def test_divide_and_conquer(name):
    a = MATRICES[name]
    values, vectors = whitening.eigenvectors(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size, rtol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-13) and np.allclose(a @ vectors, vectors * values, atol=1e-13 * size, rtol=0)


def test_polar_factor_is_the_sign():
    q = np.linalg.qr(RNG.standard_normal((8, 8)))[0]
    signs = np.array([1, 1, -1, 1, -1, -1, 1, 1.0])
    a = q @ np.diag(signs * 10.0 ** -np.arange(8)) @ q.T
    assert np.allclose(whitening.polar(a), q @ np.diag(signs) @ q.T, atol=1e-7)

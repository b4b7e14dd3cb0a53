"""Whitening against numpy's own eigenvectors."""

import math

import numpy as np
import pytest

from provspark.llm import whitening

NAN, INF = float("nan"), float("inf")


def brute(vectors, k=8):
    """By the contract's words: whole covariance, eigh; {row: (n, deviation, whitened)} and e / trace."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    m = np.array(x, float) - np.array(sums) / n
    e, u = np.linalg.eigh(m.T @ m / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, far, m @ u / np.sqrt(e), e / (np.square(m).sum() / n)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, x int, component string")


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(c)) for c in v] for v in rng.normal(size=(n, d)) * np.linspace(1, 0.3, d) + rng.normal(size=d)]


@pytest.mark.parametrize(("n", "d"), [(300, 20), (60, 9), (40, 3), (6, 20)])
def test_matches_numpy(spark, n, d):
    vs = vectors(n, d)
    want_n, far, want, explained = brute(vs, min(8, d, n - 1))
    rows = whitening.whiten(table(spark, list(enumerate(vs)))).collect()
    k = want.shape[1]
    assert len(rows) == n * k
    got = np.zeros((n, k))
    for r in rows:
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == want_n and r["deviation"] == far[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-8


def test_rows_that_do_not_count(spark):
    """Nulls, NaN, infinities, other lengths, empty vectors and what no long holds give nothing and change nothing; repeated rows and null ids stay."""
    good = vectors(30, 4)
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [NAN, 1.0, 1.0, 1.0]), (103, [INF, 0.0, 0.0, 0.0]), (104, [-INF, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, []), (107, [1e300, 0.0, 0.0, 0.0])]
    ids = [*range(28), None, 27]
    rows = whitening.whiten(table(spark, [*zip(ids, good), *bad])).collect()
    _, far, _, _ = brute(good)
    assert len(rows) == 30 * 4 and sorted((r["deviation"], -1 if r["vec_id"] is None else r["vec_id"]) for r in rows if r["component"] == 1) == sorted((f, -1 if i is None else i) for f, i in zip(far, ids))


@pytest.mark.parametrize("vs", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None]])
def test_nothing_to_whiten(spark, vs):
    assert whitening.whiten(table(spark, list(enumerate(vs)))).collect() == []


def test_deviations_beyond_a_long():
    m = whitening.Moments(3, np.array([1 << 40, 5]))
    x = np.array([[1 << 39, 0], [0, 1 << 20], [1 << 29, 0]])
    want = [sum((3 * int(c) - int(s)) ** 2 for c, s in zip(r, m.sums)) for r in x]
    assert whitening.deviations(x, m) == [w if w < 1 << 63 else None for w in want] and None in whitening.deviations(x, m)


@pytest.mark.parametrize("most_columns", [256, 48])
@pytest.mark.parametrize("spectrum", ["flat", "steep", "ties"])
def test_iteration_certifies_what_it_returns(spectrum, most_columns):
    """Large matrices known by products alone, with restarts; equal eigenvalues are judged by their residuals."""
    d, rng = 150, np.random.default_rng(3)
    e = {"flat": np.linspace(2, 1, d), "steep": 0.8 ** np.arange(d), "ties": np.repeat(np.linspace(3, 1, d // 5), 5)}[spectrum]
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    v = u * e @ u.T
    c = whitening.iterate(lambda q: v @ q, d, float(e.sum()), 8, most_columns=most_columns)
    assert np.abs(c.values - e[:8]).max() < 1e-10 and np.abs(v @ c.vectors - c.vectors * c.values).max() < 1e-11
    assert np.abs(c.vectors.T @ c.vectors - np.eye(8)).max() < 1e-12

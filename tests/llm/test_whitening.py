"""Exact whitening against numpy's eigenvectors, and the polynomial and its roots against plain products."""

from fractions import Fraction

import numpy as np
import pytest

from claimscope.llm import whitening
from claimscope.llm.queries import registry


def _expected(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, unit = np.linalg.eigh(np.cov((fit - fit.mean(axis=0)).T, bias=True))
    return x, n, total, values[::-1], unit[:, ::-1]


def _polynomial(scatter):
    """The coefficients by Faddeev and LeVerrier's sums, in exact fractions."""
    d = len(scatter)
    one = np.array([[Fraction(int(i == j)) for j in range(d)] for i in range(d)], object)
    found, m = [Fraction(1)], np.zeros((d, d), object)
    for k in range(1, d + 1):
        m = scatter.dot(m) + found[-1] * one
        found.append(-sum(scatter.dot(m).diagonal()) / k)
    return [int(c) for c in reversed(found)]


@pytest.mark.parametrize("rank", [1, 3, 6])
def test_polynomial_and_roots(spark, rank):
    random = np.random.default_rng(rank)
    x = random.integers(-9, 10, (6, rank))
    scatter = (x @ x.T).astype(object)
    found = whitening.characteristic_polynomial(spark, scatter)
    assert found == _polynomial(scatter)
    roots = whitening.largest_roots(found, 6)
    values = np.linalg.eigvalsh(scatter.astype(float))[::-1][:rank]
    assert sum(r.count for r in roots) == np.linalg.matrix_rank(scatter.astype(float))
    assert np.allclose([float(r.value) for r in roots for _ in range(r.count)], values[: sum(r.count for r in roots)], rtol=1e-9)


def test_roots_that_coincide(spark):
    scatter = np.diag([7, 7, 7, 2, 0]).astype(object)
    roots = whitening.largest_roots(whitening.characteristic_polynomial(spark, scatter), 5)
    assert [(round(float(r.value), 9), r.count) for r in roots] == [(7.0, 3), (2.0, 1)]
    found = np.array(whitening._null_vectors(scatter, roots[0]))
    assert np.allclose(found @ found.T, np.eye(3), atol=1e-15) and np.allclose(found[:, 3:], 0, atol=1e-15)


def test_query_against_numpy(spark, sf_dir):
    rows = registry.queries["op11_whitening"](spark, sf_dir).collect()
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, n, total, values, unit = _expected([r["embedding"] for r in given])
    place = {r["vec_id"]: i for i, r in enumerate(given)}
    assert len(rows) == 16 * len(given)
    projected = (x - total / n) @ unit[:, :16] / np.sqrt(values[:16])
    found = np.zeros_like(projected)
    for r in rows:
        i, c = place[r["vec_id"]], r["component"] - 1
        found[i, c] = r["whitened"]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], total))
        assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = np.sign((found * projected).sum(axis=0))
    assert np.abs(found - signs * projected).max() < 1e-8


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1e30, 1.0]), (7, [3.0, 2.5]), (8, [1.0]), (9, [4.0, 9.0]), (9, [0.0, 1.0]), (10, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, n int")
    vectors = whitening.whole_vectors(df)
    model = whitening.fit(vectors, 16)
    found = whitening.by_component(whitening.whiten(vectors, model), model).collect()
    assert model.n == 4 and sorted(str(r["vec_id"]) for r in found) == sorted(str(i) for i in [1, None, 7, 9, 9] * 2)
    same = [r["whitened"] for r in found if r["vec_id"] in (1, None) and r["component"] == 1]
    assert same[0] == same[1] and model.identity_error < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])] * 3, [(1, []), (2, [])], [(1, None)]])
def test_without_variance(spark, rows):
    vectors = whitening.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    model = whitening.fit(vectors)
    found = whitening.whiten(vectors, model)
    assert whitening.by_component(found, model).count() == 0
    assert found.count() == sum(v is not None for _, v in rows)


def test_numbers_beyond_a_double(spark):
    """Entries near 2^55, so that products do not fit into 64 bits, and deviations beyond long."""
    rows = [(i, [float(v), float(v * v % 7)]) for i, v in enumerate([1 << 49, -(1 << 49), 5, 1 << 48])]
    vectors = whitening.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    n, sums, scatter = whitening.exact_scatter(vectors)
    x = [[64 * int(c) for c in v] for _, v in rows]
    assert n == 4 and sums == [sum(c) for c in zip(*x)]
    assert scatter.tolist() == [[4 * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in (0, 1)] for i in (0, 1)]
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(vectors, whitening.fit(vectors)).collect()}
    assert {i: int(v) for i, v in found.items()} == {i: sum((4 * c - s) ** 2 for c, s in zip(r, sums)) for i, r in enumerate(x)}

"""The neighbour join and what is built on it, against searches of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import classify, neighbours, outliers


def _cloud(size, features, seed, copies=0):
    """Clusters of different density, lone points, and one point many times."""
    random = np.random.default_rng(seed)
    centres = random.normal(0, 8, (5, features))
    x = np.concatenate([c + random.normal(0, w, (size // 5, features)) for c, w in zip(centres, (0.1, 0.3, 1, 2, 6))])
    return np.round(np.concatenate([x, np.repeat(x[:1], copies, axis=0)]), 2)


def _frame(spark, x, start=0):
    names = [f"f{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(start + i, *map(float, v)) for i, v in enumerate(x)], ["id", *names]), names


@pytest.mark.parametrize("features, copies, block", [(1, 0, 4000), (3, 150, 7), (8, 0, 4000)])
def test_nearest_of_all(spark, monkeypatch, features, copies, block):
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", block)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 5 * block)
    base, names = _frame(spark, _cloud(300, features, 1, copies))
    asked, _ = _frame(spark, np.concatenate([_cloud(100, features, 2), [[1e6] * features]]))
    base, asked = neighbours.distinct_points(base, names), neighbours.distinct_points(asked, names)
    rows = {r["point"]: (r["n"], [r[f] for f in names]) for r in base.collect()}
    queries = {r["point"]: [r[f] for f in names] for r in asked.collect()}
    found = {r["point"]: [(x["point"], x["n"]) for x in r["neighbours"]] for r in neighbours.nearest_neighbours(asked, base, names, 7).collect()}
    assert found.keys() == queries.keys()
    for point, at in queries.items():
        near = sorted((np.sqrt(sum((a - b) * (a - b) for a, b in zip(at, v))), v, i, n) for i, (n, v) in rows.items())
        held, expected = 0, []
        for _, _, i, n in near:
            if held < 7:
                expected.append((i, n))
                held += n
        assert found[point] == expected


def test_fewer_rows_than_neighbours(spark):
    x, names = _frame(spark, np.array([[0.0], [1.0], [1.0]]))
    points = neighbours.distinct_points(x, names)
    assert sorted(len(r["neighbours"]) for r in neighbours.nearest_neighbours(points, points, names, 9).collect()) == [2, 2]
    assert [r["neighbours"] for r in neighbours.nearest_neighbours(points, points.limit(0), names, 2).collect()] == [[], []]


def _factors(fit, asked, k):
    """Local outlier factors by the definition, over all pairs."""

    def near(x, base, own=None):
        d = np.sqrt(((base - x) ** 2).sum(axis=1))
        order = sorted((i for i in range(len(base)) if i != own), key=lambda i: (d[i], list(base[i])))[:k]
        return order, d[order]

    around = [near(x, fit, i) for i, x in enumerate(fit)]
    radius = np.array([d[-1] for _, d in around])
    density = np.array([1 / (np.maximum(d, radius[i]).mean() + 1e-10) for i, d in around])
    fitted = [density[i].mean() / density[j] for j, (i, _) in enumerate(around)]
    scores = []
    for x in asked:
        i, d = near(x, fit)
        scores.append(density[i].mean() * (np.maximum(d, radius[i]).mean() + 1e-10))
    return scores, np.quantile(fitted, 0.9)


def test_local_outlier_factors_of_all_fit_rows(spark):
    fit, asked = _cloud(250, 2, 3, copies=8), _cloud(60, 2, 4)
    (fit_rows, names), (rows, _) = _frame(spark, fit), _frame(spark, np.concatenate([asked, fit[:20]]))
    rows = rows.unionAll(spark.createDataFrame([(999, None, 1.0)], rows.schema))
    found = {r["id"]: r for r in outliers.local_outlier_factor(fit_rows, rows, "id", names, k=10).collect()}
    scores, cut = _factors(fit, np.concatenate([asked, fit[:20]]), 10)
    assert len(found) == 81 and found[999]["lof"] is None and not found[999]["lof_outlier"]
    assert np.allclose([found[i]["lof"] for i in range(80)], scores, rtol=1e-6)
    assert [found[i]["lof_outlier"] for i in range(80)] == [s > cut for s in scores]
    alone = outliers.local_outlier_factor(fit_rows.limit(1), rows, "id", names)
    assert alone.where("lof IS NULL AND NOT lof_outlier").count() == 81


@pytest.mark.parametrize("features, eps", [(2, 0.7), (8, 3.0)])
def test_density_noise_in_many_features(spark, features, eps):
    x = _cloud(300, features, 5, copies=12)
    rows, names = _frame(spark, x)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= 5
    noise = {int(i) for i in np.flatnonzero(~core & ~(near & core[None]).any(axis=1))}
    found = {r["id"] for r in outliers.dbscan_noise(rows, "id", names, eps).where("is_noise").collect()}
    assert found == noise and 0 < len(noise) < len(x)


def test_synthetic_rows_lie_between_neighbours(spark):
    x = np.concatenate([_cloud(40, 2, 6, copies=3), _cloud(300, 2, 7)])
    rows, names = _frame(spark, x)
    rows = rows.withColumn("y", F.col("id") < 43)
    out = classify.oversample(rows, "id", "y", names, k=3)
    made = out.where("synthetic").collect()
    assert len(made) == 300 - 43 and len({r["id"] for r in made}) == len(made)
    small = x[:43]
    for r in made:
        i = int(r["id"].split("-")[0])
        d = np.sqrt(((small - small[i]) ** 2).sum(axis=1))
        near = sorted((j for j in range(43) if j != i), key=lambda j: (d[j], list(small[j])))[:3]
        at = np.array([r[f] for f in names])

        def between(j):
            step = small[j] - small[i]
            t = 0.0 if not step.any() else float((at - small[i]) @ step / (step @ step))
            return -1e-9 <= t <= 1 and np.allclose(small[i] + t * step, at)

        assert any(between(j) for j in near)

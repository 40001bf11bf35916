"""Outlier detectors fitted on one table (usually the non-fraud rows) and applied to another.

Fitted parameters are a few numbers per feature; scoring is column arithmetic. Detectors
by neighbours search them among all fit rows (``neighbours``); isolation trees draw samples of a
size set by parameter and score every row in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.functions.skew import quantiles
from claimscope.operators.neighbours import distinct_points, nearest_neighbours, weighed
from claimscope.session import materialise


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


@dataclass
class Fitted:
    """Location, spread, quartiles and inverse covariance of the fit rows."""

    features: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    quartiles: dict[str, dict[float, float]]
    mad: dict[str, float]
    inverse: np.ndarray | None


def moments(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    found = rows.agg(
        *[F.avg(a).alias(f"m_{a}") for a in features],
        *[F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs],
    ).first()
    mean = np.array([found[f"m_{a}"] for a in features], dtype=float)
    cov = np.zeros((len(features), len(features)))
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        cov[i, j] = cov[j, i] = found[f"c_{a}_{b}"] or 0.0
    return mean, cov


def fit(rows: DataFrame, features: list[str]) -> Fitted:
    mean, cov = moments(rows, features)
    cuts = quantiles(rows, {f: [0.25, 0.5, 0.75] for f in features})
    off = rows.select(*[F.abs(F.col(f) - cuts[f][0.5]).alias(f) for f in features])
    mads = quantiles(off, {f: [0.5] for f in features})
    try:
        inverse = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        inverse = None
    return Fitted(
        features,
        dict(zip(features, mean.tolist())),
        dict(zip(features, np.sqrt(np.diag(cov)).tolist())),
        cuts,
        {f: mads[f][0.5] or 1e-8 for f in features},
        inverse,
    )


def z_scores(model: Fitted) -> dict[str, Column]:
    return {f: (F.col(f) - model.mean[f]) / F.lit(model.std[f]) for f in model.features}


def zscore_outlier(model: Fitted, threshold: float = 3.0) -> Column:
    return _any([F.abs(z) > threshold for z in z_scores(model).values()])


def iqr_outlier(model: Fitted, factor: float = 1.5) -> Column:
    found = []
    for f in model.features:
        low, high = model.quartiles[f][0.25], model.quartiles[f][0.75]
        found.append((F.col(f) < low - factor * (high - low)) | (F.col(f) > high + factor * (high - low)))
    return _any(found)


def modified_zscore_outlier(model: Fitted, threshold: float = 3.5) -> Column:
    return _any(
        [F.abs(F.col(f) - model.quartiles[f][0.5]) * 0.6745 / F.lit(model.mad[f]) > threshold for f in model.features]
    )


def mahalanobis_distance(features: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Distance as column arithmetic over the k x k inverse covariance."""
    off = [F.col(f) - float(m) for f, m in zip(features, mean)]
    total = F.lit(0.0)
    for i, a in enumerate(off):
        for j in range(i, len(off)):
            weight = float(inverse[i, j]) * (1 if i == j else 2)
            total = total + a * off[j] * weight
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def mahalanobis_outliers(rows: DataFrame, model: Fitted, share: float = 0.95) -> DataFrame:
    """Add ``mahalanobis``: farther than the ``share`` quantile of the scored rows."""
    if model.inverse is None:
        return rows.withColumn("mahalanobis", F.lit(False))
    mean = np.array([model.mean[f] for f in model.features])
    distance = mahalanobis_distance(model.features, mean, model.inverse)
    cut = quantiles(rows.select(distance.alias("d")), {"d": [share]})["d"][share]
    return rows.withColumn("mahalanobis", distance > cut)


METHODS = ["zscore", "iqr", "modified_zscore", "mahalanobis"]


def statistical_votes(rows: DataFrame, model: Fitted) -> DataFrame:
    """The four statistical flags, their share, and the majority of at least two."""
    flagged = mahalanobis_outliers(rows, model).withColumns(
        {
            "zscore": zscore_outlier(model),
            "iqr": iqr_outlier(model),
            "modified_zscore": modified_zscore_outlier(model),
        }
    )
    votes = sum((F.col(m).cast("int") for m in METHODS), F.lit(0))
    return flagged.withColumns({"vote_score": votes / 4, "statistical_outlier": votes >= 2})


def ensemble(rows: DataFrame, methods: dict[str, str], features: list[str]) -> DataFrame:
    """Combine detectors given as flag column -> score column.

    An outlier needs half the votes; its contributing features are the first five beyond 2.
    """
    flags = [F.col(m).cast("double") for m in methods]
    scores = [F.col(s).cast("double") for s in methods.values()]
    ratio = sum(flags, F.lit(0.0)) / len(flags)
    extreme = F.array_compact(F.array(*[F.when(F.abs(F.col(f)) > 2, F.lit(f)) for f in features]))
    outlier = F.col("vote_ratio") >= 0.5
    return (
        rows.withColumn("vote_ratio", ratio)
        .withColumn("anomaly_score", sum(scores, F.lit(0.0)) / len(scores))
        .withColumn("is_anomaly", outlier)
        .withColumn("confidence", F.greatest(F.col("vote_ratio"), 1 - F.col("vote_ratio")))
        .withColumn(
            "methods", F.array_compact(F.array(*[F.when(F.col(m), F.lit(m)) for m in methods]))
        )
        .withColumn("contributing_features", F.when(outlier, F.slice(extreme, 1, 5)).otherwise(F.array().cast("array<string>")))
    )


def outlier_metrics(rows: DataFrame, flag: str, label: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a flag against labels."""
    hit, truth = F.col(flag), F.col(label)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    counts = rows.agg(
        count(hit & truth).alias("tp"), count(hit & ~truth).alias("fp"),
        count(~hit & truth).alias("fn"), count(~hit & ~truth).alias("tn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates from the four counts; undefined ones are 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return (
        counts.withColumn("accuracy", share(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", share(tp, tp + fp))
        .withColumn("recall", share(tp, tp + fn))
        .withColumn("f1", share(2 * tp, 2 * tp + fp + fn))
        .withColumn("false_positive_rate", share(fp, fp + tn))
    )


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"),
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score"),
        F.count(F.when(F.col("is_anomaly") & (F.col("confidence") > 0.8), 1)).alias("high_confidence"),
    )


def most_anomalous(rows: DataFrame, key: str, k: int = 10, above: float = 0.8) -> DataFrame:
    """The ``k`` highest scores among outliers of high confidence."""
    sure = rows.where(F.col("is_anomaly") & (F.col("confidence") > above))
    return sure.orderBy(F.desc("anomaly_score"), key).limit(k)


# --- density ----------------------------------------------------------------------


def dbscan_noise(rows: DataFrame, key: str, features: list[str], eps: float = 0.5, minimum: int = 5) -> DataFrame:
    """Rows that are neither core points nor within ``eps`` of one, in any number of features.

    A row is a core point if its ``minimum`` nearest rows, itself included, are within ``eps``; the
    others are noise unless the core point nearest to them is. Both are searches for a few
    neighbours, so the work does not grow with the number of rows in a dense place. Rows with a
    null feature are noise.
    """
    points = distinct_points(rows, features)
    nearest = nearest_neighbours(points, points, features, minimum)
    held = F.aggregate("neighbours", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    core = (held >= minimum) & (F.element_at("neighbours", -1)["distance"] <= eps)
    marked = materialise(points.join(nearest.select("point", core.alias("core")), "point"))
    beside = nearest_neighbours(marked.where("NOT core").drop("core"), marked.where("core").drop("core"), features, 1)
    close = beside.where(F.try_element_at("neighbours", F.lit(1))["distance"] <= eps).select("point", F.lit(True).alias("close"))
    quiet = marked.join(close, "point", "left").where("core OR close").select(*features, F.lit(True).alias("quiet"))
    numbers = rows.select(key, *[F.col(f).cast("double").alias(f) for f in features])
    return numbers.join(quiet, features, "left").select(key, F.col("quiet").isNull().alias("is_noise"))


def fit_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """A repeatable sample of ``size`` rows by hashed key; a parameter of the fit only.

    Rows beyond a hash limit are dropped before the ordering, so little is sorted.
    """
    total = rows.count()
    spot = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000))
    share = min(1_000_000, math.ceil(3_000_000 * size / max(total, 1)) + 100)
    thinned = rows.where(spot < share) if share < 1_000_000 else rows
    return thinned.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(size)


# --- isolation forest ----------------------------------------------------------------

_TREE = (
    "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, depth array<double>, size int"
)


def _path_constant(n: int) -> float:
    """Mean depth of an unsuccessful search among n rows."""
    if n <= 2:
        return float(max(n - 1, 0))
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def isolation_trees(
    rows: DataFrame, key: str, features: list[str], trees: int = 100, size: int = 256, seed: int = 42
) -> list[dict]:
    """Random isolation trees, one task per tree over its own sample of ``size`` rows.

    Samples are drawn without replacement from at most ``trees * size`` rows; a smaller table
    gives all its rows to every tree.
    """
    sample = fit_sample(rows.select(key, *features), key, trees * size, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        height = math.ceil(math.log2(max(len(group), 2)))
        feature, cut, low, high, depth = [], [], [], [], []

        def node(values: np.ndarray, level: int) -> int:
            place = len(feature)
            for part, empty in ((feature, -1), (cut, 0.0), (low, -1), (high, -1)):
                part.append(empty)
            depth.append(level + _path_constant(len(values)))
            spans = np.ptp(values, axis=0) if len(values) else np.zeros(len(features))
            if level >= height or len(values) <= 1 or not spans.any():
                return place
            f = int(rng.choice(np.flatnonzero(spans)))
            c = float(rng.uniform(values[:, f].min(), values[:, f].max()))
            feature[place], cut[place] = f, c
            low[place] = node(values[values[:, f] < c], level + 1)
            high[place] = node(values[values[:, f] >= c], level + 1)
            return place

        node(group[features].to_numpy(dtype=float), 0)
        return pd.DataFrame(
            {
                "tree": [tree], "feature": [feature], "cut": [cut], "low": [low], "high": [high], "depth": [depth],
                "size": [len(group)],
            }
        )

    spread = sample.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(key), "tree", F.lit(seed + 1)), key)
    dealt = spread.withColumn("_draw", F.row_number().over(drawn)).where(F.col("_draw") <= size).drop("_draw")
    return [row.asDict() for row in dealt.groupBy("tree").applyInPandas(grow, _TREE).orderBy("tree").collect()]


def isolation_scores(
    rows: DataFrame, key: str, features: list[str], forest: list[dict]
) -> DataFrame:
    """Anomaly score in (0, 1]: the shorter the mean path, the nearer to 1; 0.5 from trees of one row."""
    arrays = [
        tuple(np.array(tree[c]) for c in ("feature", "cut", "low", "high", "depth")) for tree in forest
    ]
    usual = sum(_path_constant(tree["size"]) for tree in forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch[features].to_numpy(dtype=float)
            total = np.zeros(len(values))
            for feature, cut, low, high, depth in arrays:
                at = np.zeros(len(values), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    left = values[inner, feature[at[inner]]] < cut[at[inner]]
                    at[inner] = np.where(left, low[at[inner]], high[at[inner]])
                total += depth[at]
            yield pd.DataFrame({key: batch[key], "isolation_score": 2.0 ** (-total / usual) if usual else 0.5})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *features).mapInPandas(score, f"{key} {kind}, isolation_score double")


def isolation_outliers(
    fit_rows: DataFrame, rows: DataFrame, key: str, features: list[str], contamination: float = 0.1
) -> DataFrame:
    """Scores, and the flag beyond the contamination quantile of the fit rows' scores."""
    forest = isolation_trees(fit_rows, key, features)
    fitted = isolation_scores(fit_rows, key, features, forest).select("isolation_score")
    cut = quantiles(materialise(fitted), {"isolation_score": [1 - contamination]})["isolation_score"]
    return isolation_scores(rows, key, features, forest).withColumn(
        "isolation_outlier", F.col("isolation_score") > cut[1 - contamination]
    )


# --- neighbours ----------------------------------------------------------------------


def local_outlier_factor(
    fit_rows: DataFrame, rows: DataFrame, key: str, features: list[str], k: int = 20, contamination: float = 0.1
) -> DataFrame:
    """(key, lof, lof_outlier): local outlier factor of rows against all fit rows (novelty mode).

    Neighbours are searched among every fit row; a fit row is no neighbour of itself when densities
    are taken, but is when rows are scored, as any other row at distance 0. Rows with a null
    feature have no factor and are no outliers, and so has any row if there is one fit row only.
    """
    numbers = [F.col(f).cast("double").alias(f) for f in features]
    both = rows.select(*numbers, F.lit(0).alias("fit")).unionAll(fit_rows.select(*numbers, F.lit(1).alias("fit"))).dropna()
    points = both.groupBy(*features).agg(F.sum("fit").alias("n"))
    points = materialise(points.select(F.monotonically_increasing_id().alias("point"), *features, "n"))
    base = points.where("n > 0")
    k = min(k, int(base.agg(F.sum("n")).first()[0] or 0) - 1)
    scored = rows.select(key, *numbers)
    if k < 1:
        return scored.select(key, F.lit(None).cast("double").alias("lof"), F.lit(False).alias("lof_outlier"))
    found = nearest_neighbours(points, base, features, k + 1)
    own = materialise(
        found.join(base.select("point", "n"), "point", "left_semi")
        .select("point", weighed(F.col("neighbours"), k, F.col("point")).alias("near"))
        .withColumn("radius", F.element_at("near", -1)["distance"])
    )
    radius = own.select(F.col("point").alias("neighbour"), "radius")

    def densities(lists: DataFrame) -> DataFrame:
        """One over the mean distance to the neighbours, where none counts as nearer than its own radius."""
        reach = F.sum(F.col("rows") * F.greatest("distance", "radius")) / k
        return _apart(lists).join(radius, "neighbour").groupBy("point").agg((1 / (reach + 1e-10)).alias("density"))

    fitted = materialise(densities(own))
    of_neighbour = fitted.select(F.col("point").alias("neighbour"), F.col("density").alias("theirs"))

    def factors(lists: DataFrame, density: DataFrame) -> DataFrame:
        around = _apart(lists).join(of_neighbour, "neighbour").groupBy("point").agg((F.sum(F.col("rows") * F.col("theirs")) / k).alias("around"))
        return around.join(density, "point").join(points, "point").select(*features, (F.col("around") / F.col("density")).alias("lof"))

    known = fit_rows.select(*numbers).join(factors(own, fitted), features).select("lof")
    cut = quantiles(materialise(known), {"lof": [1 - contamination]})["lof"][1 - contamination]
    lists = materialise(found.select("point", weighed(F.col("neighbours"), k).alias("near")))
    out = scored.join(factors(lists, densities(lists)), features, "left")
    return out.select(key, "lof", F.coalesce(F.col("lof") > cut, F.lit(False)).alias("lof_outlier"))


def _apart(lists: DataFrame) -> DataFrame:
    """A row for each query and neighbour."""
    return lists.select("point", F.explode("near").alias("x")).select("point", F.col("x.point").alias("neighbour"), "x.distance", "x.rows")


# --- robust covariance and reconstruction ------------------------------------------------


def _chi_square(x: float, freedom: int) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if half <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def consistency_factor(share: float, features: int) -> float:
    """What the covariance of the closest ``share`` of normal rows is to be multiplied with to be that of all."""
    low, high = 0.0, 1.0
    while _chi_square(high, features) < share:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, features) < share else (low, middle)
    return share / _chi_square(high, features + 2)


def _moments_where(rows: DataFrame, features: list[str], conditions: list[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows of each condition, all in one pass.

    Each task gives one row a condition: how many rows, their mean, and their products about it.
    """
    k, names = len(features), [f"_c{n}" for n in range(len(conditions))]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [_no_rows(k) for _ in names]
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
            for i, name in enumerate(names):
                part = x[np.asarray(batch.column(name).fill_null(False).to_numpy(zero_copy_only=False), bool)]
                if len(part):
                    mean = part.mean(axis=0)
                    sums[i] = _united(sums[i], (len(part), mean, (part - mean).T @ (part - mean)))
        found = [pa.array(list(range(len(names))), pa.int32()), pa.array([s[0] for s in sums], pa.int64())]
        found += [pa.array([s[1].tolist() for s in sums], pa.list_(pa.float64())), pa.array([s[2].ravel().tolist() for s in sums], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(found, ["condition", "n", "mean", "products"])

    marked = rows.select(*features, *[c.alias(name) for c, name in zip(conditions, names)])
    found = marked.mapInArrow(add, "condition int, n long, mean array<double>, products array<double>").where("n > 0").collect()
    totals = [_no_rows(k) for _ in names]
    for r in found:
        totals[r["condition"]] = _united(totals[r["condition"]], (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
    return [(mean, products / (n - 1) if n > 1 else np.zeros((k, k))) for n, mean, products in totals]


def _no_rows(k: int) -> tuple[int, np.ndarray, np.ndarray]:
    return 0, np.zeros(k), np.zeros((k, k))


def _united(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and products about the mean of two sets of rows together."""
    n, off = a[0] + b[0], b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def minimum_covariance(
    rows: DataFrame, features: list[str], starts: int = 50, kept: int = 5, start_rows: int = 2000, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of the rows whose covariance has the smallest determinant.

    Many random starts, of one row more than there are features, take two concentration steps
    (the closest half gives the next mean and covariance) on ``start_rows`` rows drawn by a hash;
    they are places to begin at only. The best ``kept`` go on over all rows, side by side in the
    same passes, until no determinant falls any more, and the smallest wins. A millionth of each
    feature's variance is added, so that rows off a plane that holds half of them are far away.
    """
    rows = materialise(rows.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna())
    _, whole = moments(rows, features)
    ridge = np.diag(np.maximum(np.diag(whole), 1e-300)) * 1e-6
    total = rows.count()
    spot = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(1_000_000_000))
    near = rows.where(spot < math.ceil(1e9 * min(1.0, 2 * start_rows / max(total, 1)))).orderBy(spot, *features).limit(start_rows)
    x = np.array([list(r) for r in near.collect()], dtype=float).reshape(-1, len(features))
    if len(x) <= len(features) + 1:
        return moments(rows, features)
    rng = np.random.default_rng(seed)
    begun = []
    for _ in range(starts):
        chosen = x[rng.choice(len(x), len(features) + 1, replace=False)]
        mean, cov = chosen.mean(axis=0), np.atleast_2d(np.cov(chosen.T)) + ridge
        for _ in range(2):
            off = x - mean
            closest = x[np.argsort((off @ np.linalg.inv(cov) * off).sum(axis=1), kind="stable")[: len(x) // 2 + 1]]
            mean, cov = closest.mean(axis=0), np.atleast_2d(np.cov(closest.T)) + ridge
        begun.append((np.linalg.slogdet(cov)[1], mean, cov))
    begun.sort(key=lambda c: c[0])
    # determinants of the drawn rows do not count: the first step over all rows is always taken
    going, ended = [(math.inf, mean, cov) for _, mean, cov in begun[:kept]], []
    while going:
        distances = [mahalanobis_distance(features, mean, np.linalg.inv(cov)) for _, mean, cov in going]
        cuts = quantiles(rows.select(*[d.alias(f"d{i}") for i, d in enumerate(distances)]), {f"d{i}": [0.5] for i in range(len(going))})
        stepped = _moments_where(rows, features, [d <= cuts[f"d{i}"][0.5] for i, d in enumerate(distances)])
        after = [(float(np.linalg.slogdet(cov + ridge)[1]), mean, cov + ridge) for mean, cov in stepped]
        ended += [a for a, g in zip(after, going) if a[0] >= g[0] - 1e-9]
        going = _different([a for a, g in zip(after, going) if a[0] < g[0] - 1e-9])
    _, mean, cov = min(ended, key=lambda c: c[0])
    return mean, cov * consistency_factor(0.5, len(features))


def _different(candidates: list[tuple[float, np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Candidates that have come together count once."""
    found: list[tuple[float, np.ndarray, np.ndarray]] = []
    for c in candidates:
        if not any(abs(c[0] - f[0]) < 1e-9 and np.allclose(c[1], f[1], rtol=1e-9) for f in found):
            found.append(c)
    return found


def robust_covariance_outliers(fit_rows: DataFrame, rows: DataFrame, features: list[str], contamination: float = 0.1) -> DataFrame:
    """Distance from the mean and covariance of the densest half of the fit rows (``minimum_covariance``)."""
    mean, cov = minimum_covariance(fit_rows, features)
    distance = mahalanobis_distance(features, mean, np.linalg.pinv(cov))
    limit = quantiles(fit_rows.select(distance.alias("d")), {"d": [1 - contamination]})["d"][1 - contamination]
    return rows.withColumns({"robust_distance": distance, "covariance_outlier": distance > limit})


def reconstruction_outliers(
    fit_rows: DataFrame, rows: DataFrame, features: list[str], components: int, share: float = 0.95
) -> DataFrame:
    """Mean squared error after projecting standardised features on the main components."""
    mean, cov = moments(fit_rows, features)
    std = np.sqrt(np.diag(cov))
    std[std == 0] = 1.0
    scaled = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mean, std)]
    vectors = fit_rows.select(array_to_vector(F.array(*scaled)).alias("x"))
    axes = PCA(k=components, inputCol="x", outputCol="p").fit(vectors).pc.toArray()
    residual = np.eye(len(features)) - axes @ axes.T
    error = F.lit(0.0)
    for row in residual:
        part = sum((x * float(w) for x, w in zip(scaled, row)), F.lit(0.0))
        error = error + part * part
    error = error / len(features)
    cut = quantiles(fit_rows.select(error.alias("e")), {"e": [share]})["e"][share]
    return rows.withColumns({"reconstruction_error": error, "reconstruction_outlier": error > cut})

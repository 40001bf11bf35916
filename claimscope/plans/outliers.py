"""Outlier queries, fitted on the claims not labelled as fraud."""

from pyspark.sql import functions as F

from claimscope.functions.columns import joined, or_empty, rounded
from claimscope.operators import outliers as O
from claimscope.operators.detection import VOTES, full_ensemble
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.registry import Registry
from claimscope.session import materialise
from claimscope.sources.tables import claims

registry = Registry()

FEATURES = ["amount", "procedures", "diagnoses"]

POINTS = """points AS (SELECT claim_id, fraud_indicator, billed_amount::DOUBLE AS amount,
  coalesce(len(procedure_codes), 0)::DOUBLE AS procedures, coalesce(len(diagnosis_codes), 0)::DOUBLE AS diagnoses
  FROM claims), normal AS (SELECT * FROM points WHERE NOT fraud_indicator)"""


def points(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "fraud_indicator", "billed_amount", "procedure_codes", "diagnosis_codes")
    return rows.select(
        "claim_id", "fraud_indicator", F.col("billed_amount").cast("double").alias("amount"),
        F.size(or_empty("procedure_codes")).cast("double").alias("procedures"),
        F.size(or_empty("diagnosis_codes")).cast("double").alias("diagnoses"),
    )


def fitted(rows):
    return O.fit(rows.where("NOT fraud_indicator"), FEATURES)


def _params(expression):
    return ", ".join(expression.format(f=f) for f in FEATURES)


FIT = [
    POINTS,
    "m AS (SELECT " + _params("avg({f}) AS {f}_m, stddev_samp({f}) AS {f}_s") + ", "
    + ", ".join(
        f"corr({a}, {b}) AS r{i}{j}" for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES) if i < j
    )
    + " FROM normal)",
    "q AS (SELECT " + _params(
        "quantile_cont({f}, 0.25) AS {f}_q1, quantile_cont({f}, 0.75) AS {f}_q3, median({f}) AS {f}_med"
    ) + " FROM normal)",
    "mads AS (SELECT " + _params(
        "coalesce(nullif(median(abs({f} - {f}_med)), 0), 1e-8) AS {f}_mad"
    ) + " FROM normal, q)",
    "z AS (SELECT claim_id, fraud_indicator, " + _params("{f}") + ", "
    + _params("({f} - {f}_m) / {f}_s AS z_{f}") + ", r01, r02, r12 FROM points, m)",
    """distances AS (SELECT claim_id, sqrt(greatest(0, ((1 - r12 * r12) * z_amount * z_amount
        + (1 - r02 * r02) * z_procedures * z_procedures + (1 - r01 * r01) * z_diagnoses * z_diagnoses
        + 2 * (r02 * r12 - r01) * z_amount * z_procedures + 2 * (r01 * r12 - r02) * z_amount * z_diagnoses
        + 2 * (r01 * r02 - r12) * z_procedures * z_diagnoses)
        / (1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12))) AS d FROM z)""",
    "votes AS (SELECT z.claim_id, fraud_indicator, " + _params("{f}") + ", "
    + "greatest(" + _params("abs(z_{f})") + ") > 3 AS zscore, "
    + " OR ".join(f"({f} < {f}_q1 - 1.5 * ({f}_q3 - {f}_q1) OR {f} > {f}_q3 + 1.5 * ({f}_q3 - {f}_q1))" for f in FEATURES)
    + " AS iqr, "
    + " OR ".join(f"0.6745 * abs({f} - {f}_med) / {f}_mad > 3.5" for f in FEATURES)
    + " AS modified_zscore, d > (SELECT quantile_cont(d, 0.95) FROM distances) AS mahalanobis"
    + " FROM z JOIN distances USING (claim_id), q, mads)",
    """scored AS (SELECT *, (zscore::INTEGER + iqr::INTEGER + modified_zscore::INTEGER + mahalanobis::INTEGER) / 4
      AS vote_score FROM votes)""",
]


def _flag(name):
    return over_claims(f"SELECT claim_id, {name} FROM votes", *FIT)


@registry.query(_flag("zscore"))
def zscore_outliers(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.select("claim_id", O.zscore_outlier(fitted(rows)).alias("zscore"))


@registry.query(_flag("iqr"))
def iqr_outliers(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.select("claim_id", O.iqr_outlier(fitted(rows)).alias("iqr"))


@registry.query(_flag("modified_zscore"))
def modified_zscore_outliers(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rows.select("claim_id", O.modified_zscore_outlier(fitted(rows)).alias("modified_zscore"))


@registry.query(_flag("mahalanobis"))
def mahalanobis_outliers(spark, sf_dir):
    rows = points(spark, sf_dir)
    return O.mahalanobis_outliers(rows, fitted(rows)).select("claim_id", "mahalanobis")


@registry.query(
    over_claims("SELECT claim_id, vote_score, vote_score >= 0.5::DOUBLE AS statistical_outlier FROM scored", *FIT)
)
def statistical_outlier_votes(spark, sf_dir):
    rows = points(spark, sf_dir)
    return O.statistical_votes(rows, fitted(rows)).select("claim_id", "vote_score", "statistical_outlier")


def ensemble_rows(spark, sf_dir):
    """The four statistical detectors as an ensemble over standardised features."""
    rows = points(spark, sf_dir)
    model = fitted(rows)
    voted = O.statistical_votes(rows, model)
    z = {f: O.z_scores(model)[f] for f in FEATURES}
    return O.ensemble(voted.withColumns(z), {m: m for m in O.METHODS}, FEATURES)


_ENSEMBLE = [
    *FIT,
    """ensemble AS (SELECT claim_id, fraud_indicator, vote_score AS anomaly_score, vote_score >= 0.5::DOUBLE AS is_anomaly,
      greatest(vote_score, 1 - vote_score) AS confidence,
      array_to_string(list_filter([CASE WHEN zscore THEN 'zscore' END, CASE WHEN iqr THEN 'iqr' END,
        CASE WHEN modified_zscore THEN 'modified_zscore' END, CASE WHEN mahalanobis THEN 'mahalanobis' END],
        lambda x: x IS NOT NULL), '|') AS methods,
      CASE WHEN vote_score >= 0.5::DOUBLE THEN array_to_string(list_filter(["""
    + ", ".join(f"CASE WHEN abs(z_{f}) > 2 THEN '{f}' END" for f in FEATURES)
    + """], lambda x: x IS NOT NULL), '|') ELSE '' END AS contributing_features
      FROM scored JOIN (SELECT claim_id, """ + _params("z_{f}") + " FROM z) USING (claim_id))",
]


@registry.query(
    over_claims(
        """SELECT claim_id, anomaly_score, is_anomaly, confidence, methods, contributing_features FROM ensemble""",
        *_ENSEMBLE,
    )
)
def outlier_ensemble(spark, sf_dir):
    return ensemble_rows(spark, sf_dir).select(
        "claim_id", "anomaly_score", "is_anomaly", "confidence", joined(F.col("methods")).alias("methods"),
        joined(F.col("contributing_features")).alias("contributing_features"),
    )


@registry.query(
    over_claims(
        """SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
        round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
        round(fp / (fp + tn), 6) AS false_positive_rate FROM (
          SELECT count(*) FILTER (is_anomaly AND fraud_indicator) AS tp, count(*) FILTER (is_anomaly AND NOT fraud_indicator) AS fp,
            count(*) FILTER (NOT is_anomaly AND fraud_indicator) AS fn,
            count(*) FILTER (NOT is_anomaly AND NOT fraud_indicator) AS tn FROM ensemble)""",
        *_ENSEMBLE,
    )
)
def outlier_label_metrics(spark, sf_dir):
    out = O.outlier_metrics(ensemble_rows(spark, sf_dir), "is_anomaly", "fraud_indicator")
    rates = ("accuracy", "precision", "recall", "f1", "false_positive_rate")
    return out.withColumns({c: rounded(F.col(c)) for c in rates})


@registry.query(
    over_claims(
        """SELECT count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, round(avg(is_anomaly::INTEGER), 6) AS anomaly_rate,
        round(avg(anomaly_score), 6) AS mean_score, max(anomaly_score) AS max_score,
        count(*) FILTER (is_anomaly AND confidence > 0.8::DOUBLE) AS high_confidence FROM ensemble""",
        *_ENSEMBLE,
    )
)
def outlier_summary(spark, sf_dir):
    out = O.summary(ensemble_rows(spark, sf_dir))
    return out.withColumns({c: rounded(F.col(c)) for c in ("anomaly_rate", "mean_score")})


@registry.query(
    over_claims(
        """SELECT claim_id, anomaly_score, confidence FROM ensemble WHERE is_anomaly AND confidence > 0.7::DOUBLE
        ORDER BY anomaly_score DESC, claim_id LIMIT 10""",
        *_ENSEMBLE,
    )
)
def most_anomalous_claims(spark, sf_dir):
    found = O.most_anomalous(ensemble_rows(spark, sf_dir), "claim_id", above=0.7)
    return found.select("claim_id", "anomaly_score", "confidence")


# distances are compared with eps, so the coordinates are rounded alike on both sides
@registry.query(
    over_claims(
        """SELECT claim_id, coalesce(n, 0) < 5 AND NOT coalesce(near_core, false) AS is_noise FROM grid
        LEFT JOIN around USING (x, y) LEFT JOIN beside USING (x, y)""",
        *FIT[:2],
        "grid AS (SELECT claim_id, round((amount - amount_m) / amount_s, 3) AS x, "
        "round((procedures - procedures_m) / procedures_s, 3) AS y FROM points, m)",
        "spots AS (SELECT x, y, count(*) AS c FROM grid GROUP BY 1, 2)",
        """pairs AS (SELECT a.x, a.y, b.x AS bx, b.y AS by, b.c FROM spots a JOIN spots b
          ON b.x BETWEEN a.x - 0.2501 AND a.x + 0.2501
          AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.25::DOUBLE * 0.25::DOUBLE)""",
        "around AS (SELECT x, y, sum(c) AS n FROM pairs GROUP BY 1, 2)",
        """beside AS (SELECT p.x, p.y, true AS near_core FROM pairs p JOIN around r ON p.bx = r.x AND p.by = r.y
          WHERE r.n >= 5 GROUP BY 1, 2)""",
    )
)
def density_noise(spark, sf_dir):
    rows = points(spark, sf_dir)
    mean, cov = O.moments(rows.where("NOT fraud_indicator"), FEATURES)
    grid = rows.select(
        "claim_id",
        F.round((F.col("amount") - float(mean[0])) / float(cov[0, 0] ** 0.5), 3).alias("x"),
        F.round((F.col("procedures") - float(mean[1])) / float(cov[1, 1] ** 0.5), 3).alias("y"),
    )
    return O.dbscan_noise(materialise(grid), "claim_id", ["x", "y"], eps=0.25)


def _scaled(spark, sf_dir):
    rows = points(spark, sf_dir)
    model = fitted(rows)
    return materialise(rows.withColumns(O.z_scores(model)))


@registry.query()
def isolation_forest_outliers(spark, sf_dir):
    rows = _scaled(spark, sf_dir)
    return O.isolation_outliers(rows.where("NOT fraud_indicator"), rows, "claim_id", FEATURES)


def _grid(spark, sf_dir):
    """Standardised features to three decimals, so that distances and ties are the same on both sides."""
    rows = points(spark, sf_dir)
    mean, cov = O.moments(rows.where("NOT fraud_indicator"), FEATURES)
    scaled = [F.round((F.col(f) - float(m)) / float(v**0.5), 3).alias(c) for c, f, m, v in zip("xyz", FEATURES, mean, cov.diagonal())]
    return materialise(rows.select("claim_id", "fraud_indicator", *scaled))


_SPACE = "grid AS (SELECT claim_id, fraud_indicator, " + ", ".join(f"round(({f} - {f}_m) / {f}_s, 3) AS {c}" for c, f in zip("xyz", FEATURES)) + " FROM points, m)"
_APART = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _nearest_sql(rows, source):
    """The nearest 20 rows of each point in ``lists``, of which ``rows`` count."""
    return f"""(SELECT *, least(r, 20 - before) AS take FROM (
        SELECT *, coalesce(sum(r) OVER (PARTITION BY x, y, z ORDER BY d, nx, ny, nz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT *, {rows} AS r FROM {source}) WHERE r > 0) WHERE before < 20)"""


@registry.query(
    over_claims(
        """SELECT claim_id, round(lof, 4) AS lof, lof > cut AS lof_outlier FROM grid JOIN scored USING (x, y, z), cuts""",
        *FIT[:2],
        _SPACE,
        "fit AS (SELECT x, y, z, count(*) AS c FROM grid WHERE NOT fraud_indicator GROUP BY ALL)",
        f"""near AS (SELECT a.x, a.y, a.z, min({{'d': {_APART}, 'x': b.x, 'y': b.y, 'z': b.z, 'c': b.c}}, 21) AS l
          FROM (SELECT DISTINCT x, y, z FROM grid) a, fit b GROUP BY ALL)""",
        "lists AS (SELECT x, y, z, n.d AS d, n.x AS nx, n.y AS ny, n.z AS nz, n.c AS c FROM (SELECT x, y, z, unnest(l) AS n FROM near))",
        "own AS " + _nearest_sql("c - (nx = x AND ny = y AND nz = z)::INT", "lists SEMI JOIN fit USING (x, y, z)"),
        "novel AS " + _nearest_sql("c", "lists"),
        "radii AS (SELECT x AS nx, y AS ny, z AS nz, max(d) AS radius FROM own GROUP BY ALL)",
        """density AS (SELECT x AS nx, y AS ny, z AS nz, 1 / (sum(take * greatest(d, radius)) / 20 + 1e-10::DOUBLE) AS density
          FROM own JOIN radii USING (nx, ny, nz) GROUP BY x, y, z)""",
        """fitted AS (SELECT x, y, z, sum(take * d.density) / 20 / any_value(s.density) AS lof FROM own JOIN density d USING (nx, ny, nz)
          JOIN density s ON s.nx = x AND s.ny = y AND s.nz = z GROUP BY x, y, z)""",
        "cuts AS (SELECT quantile_cont(lof, 0.9) AS cut FROM grid JOIN fitted USING (x, y, z) WHERE NOT fraud_indicator)",
        """scored AS (SELECT x, y, z, sum(take * density) / 20 * (sum(take * greatest(d, radius)) / 20 + 1e-10::DOUBLE) AS lof
          FROM novel JOIN density USING (nx, ny, nz) JOIN radii USING (nx, ny, nz) GROUP BY x, y, z)""",
    )
)
def local_outlier_factors(spark, sf_dir):
    rows = _grid(spark, sf_dir)
    found = O.local_outlier_factor(rows.where("NOT fraud_indicator"), rows, "claim_id", ["x", "y", "z"])
    return found.withColumn("lof", rounded(F.col("lof"), 4))


@registry.query()
def robust_covariance_outliers(spark, sf_dir):
    rows = _scaled(spark, sf_dir)
    out = O.robust_covariance_outliers(rows.where("NOT fraud_indicator"), rows, FEATURES)
    return out.select("claim_id", "robust_distance", "covariance_outlier")


@registry.query()
def reconstruction_outliers(spark, sf_dir):
    rows = _scaled(spark, sf_dir)
    out = O.reconstruction_outliers(rows.where("NOT fraud_indicator"), rows, FEATURES, components=2)
    return out.select("claim_id", "reconstruction_error", "reconstruction_outlier")


@registry.query(
    over_claims(
        """SELECT claim_id, coalesce(n, 0) < 5 AND NOT coalesce(near_core, false) AS is_noise FROM grid
        LEFT JOIN around USING (x, y, z) LEFT JOIN beside USING (x, y, z)""",
        *FIT[:2],
        _SPACE,
        "spots AS (SELECT x, y, z, count(*) AS c FROM grid GROUP BY ALL)",
        f"""pairs AS (SELECT a.x, a.y, a.z, b.x AS bx, b.y AS by, b.z AS bz, b.c FROM spots a JOIN spots b
          ON b.x BETWEEN a.x - 0.5001 AND a.x + 0.5001 AND {_APART} <= 0.5::DOUBLE)""",
        "around AS (SELECT x, y, z, sum(c) AS n FROM pairs GROUP BY ALL)",
        """beside AS (SELECT p.x, p.y, p.z, true AS near_core FROM pairs p JOIN around r ON p.bx = r.x AND p.by = r.y AND p.bz = r.z
          WHERE r.n >= 5 GROUP BY ALL)""",
    )
)
def density_noise_all_features(spark, sf_dir):
    """Density noise over all FEATURES, at the usual radius of 0.5."""
    return O.dbscan_noise(_grid(spark, sf_dir), "claim_id", ["x", "y", "z"], eps=0.5)


@registry.query()
def full_outlier_ensemble(spark, sf_dir):
    """The statistical detectors and the fitted ones, each with a vote."""
    rows = materialise(points(spark, sf_dir))
    out = full_ensemble(rows.where("NOT fraud_indicator"), rows, "claim_id", FEATURES).join(rows.select("claim_id", "fraud_indicator"), "claim_id")
    return out.select(
        "claim_id", "fraud_indicator", *VOTES, "anomaly_score", "is_anomaly", "confidence",
        joined(F.col("methods")).alias("methods"), joined(F.col("contributing_features")).alias("contributing_features"),
    )

"""Classification queries over the numeric claim features."""

from pyspark.sql import functions as F

from claimscope.functions.columns import rounded
from claimscope.operators import classify as C
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.preprocessing import FEATURES, NUMERIC_SQL, numeric_features
from claimscope.plans.registry import Registry
from claimscope.session import materialise, scratch_path
from claimscope.sources.tables import claims

registry = Registry()

LABEL = "fraud_indicator"
NAMES = list(FEATURES)
# fewer and shallower trees than the defaults; the other models run with theirs
SMALLER = {
    "random_forest": {"numTrees": 20, "maxDepth": 6},
    "gradient_boosting": {"maxIter": 10, "maxDepth": 4},
}

_SPLIT = """split AS (SELECT *, CASE WHEN place / size <= 0.6::DOUBLE THEN 'train'
    WHEN place / size <= 0.6::DOUBLE + 0.2::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM (
  SELECT *, row_number() OVER (PARTITION BY fraud_indicator ORDER BY md5(claim_id || ':42'), claim_id) AS place,
    count(*) OVER (PARTITION BY fraud_indicator) AS size FROM numeric_features))"""


def split(spark, sf_dir):
    return C.stratified_split(numeric_features(spark, sf_dir), "claim_id", LABEL)


@registry.query(over_claims("SELECT claim_id, fraud_indicator, part FROM split", NUMERIC_SQL, _SPLIT))
def stratified_split(spark, sf_dir):
    return split(spark, sf_dir).select("claim_id", LABEL, "part")


@registry.query(
    over_claims(
        """SELECT fraud_indicator, count(*) AS class_count,
        round((SELECT count(*) FROM claims) / (2 * count(*)), 6) AS class_weight FROM claims GROUP BY 1"""
    )
)
def class_weights(spark, sf_dir):
    out = C.class_weights(claims(spark, sf_dir, "claim_id", LABEL), LABEL)
    return out.withColumn("class_weight", rounded(F.col("class_weight")))


_NO_GAPS = ["billed_amount", "amount_log", "procedure_count", "diagnosis_count", "red_flag_count"]


@registry.query(
    over_claims(
        """SELECT fraud_indicator, synthetic, CASE WHEN synthetic THEN m - n ELSE n END::BIGINT AS claims FROM (
          SELECT fraud_indicator, count(*) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM claims
            GROUP BY fraud_indicator)) AS m FROM claims GROUP BY 1), (VALUES (true), (false)) t(synthetic)
        WHERE NOT synthetic OR m > n"""
    )
)
def minority_oversampling(spark, sf_dir):
    out = C.oversample(numeric_features(spark, sf_dir), "claim_id", LABEL, _NO_GAPS)
    return out.groupBy(LABEL, "synthetic").agg(F.count(F.lit(1)).alias("claims"))


def _predictions(name):
    def query(spark, sf_dir):
        rows = materialise(split(spark, sf_dir))
        model = C.train(rows.where("part = 'train'"), name, NAMES, LABEL, **SMALLER.get(name, {}))
        return C.predict(model, rows.where("part = 'test'"), NAMES, "claim_id", [LABEL])

    return query


for _name in C.MODELS:
    registry.add(f"predict_{_name}", _predictions(_name))


@registry.query()
def soft_voting_ensemble(spark, sf_dir):
    rows = materialise(split(spark, sf_dir))
    out = rows.where("part = 'test'").select("claim_id", LABEL)
    names = ["random_forest", "logistic_regression", "gradient_boosting"]
    for name in names:
        model = C.train(rows.where("part = 'train'"), name, NAMES, LABEL, **SMALLER.get(name, {}))
        found = C.predict(model, rows.where("part = 'test'"), NAMES, "claim_id")
        out = out.join(found.select("claim_id", F.col("fraud_probability").alias(name)), "claim_id")
    return C.soft_vote(out, names)


# three saved probability columns without a model: amount, provider and flag rates
_SAVED = [
    NUMERIC_SQL,
    """saved AS (SELECT c.claim_id, c.fraud_indicator, least(1, c.billed_amount::DOUBLE / 20000) AS by_amount,
      coalesce(rate, 0.5) AS by_provider, len(c.red_flags) / 4 AS by_flags FROM claims c
      LEFT JOIN (SELECT provider_id, avg(fraud_indicator::INTEGER) AS rate FROM claims
        WHERE provider_id IS NOT NULL GROUP BY 1) USING (provider_id))""",
]


def saved_probabilities(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", LABEL, "billed_amount", "provider_id", "red_flags")
    rates = rows.where("provider_id IS NOT NULL").groupBy("provider_id").agg(
        F.avg(F.col(LABEL).cast("double")).alias("rate")
    )
    return rows.join(rates, "provider_id", "left").select(
        "claim_id", LABEL,
        F.least(F.lit(1.0), F.col("billed_amount").cast("double") / 20000).alias("by_amount"),
        F.coalesce("rate", F.lit(0.5)).alias("by_provider"),
        (F.size("red_flags") / 4).alias("by_flags"),
    )


@registry.query(
    over_claims(
        """SELECT claim_id, p AS ensemble_probability, (p >= 0.5::DOUBLE)::BIGINT AS ensemble_prediction
        FROM (SELECT claim_id, (by_amount + by_provider + by_flags) / 3 AS p FROM saved)""",
        *_SAVED,
    )
)
def soft_vote_of_saved_probabilities(spark, sf_dir):
    out = C.soft_vote(saved_probabilities(spark, sf_dir), ["by_amount", "by_provider", "by_flags"])
    return out.select("claim_id", "ensemble_probability", "ensemble_prediction")


_METRICS_SQL = """SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / (fp + tn), 6) AS false_positive_rate,
  round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision
  FROM (SELECT count(*) FILTER (s >= 0.5::DOUBLE AND fraud_indicator) AS tp,
      count(*) FILTER (s >= 0.5::DOUBLE AND NOT fraud_indicator) AS fp,
      count(*) FILTER (s < 0.5::DOUBLE AND fraud_indicator) AS fn,
      count(*) FILTER (s < 0.5::DOUBLE AND NOT fraud_indicator) AS tn FROM scores),
    (SELECT (sum(r) FILTER (fraud_indicator) - p * (p + 1) / 2) / (p * n) AS auc FROM (
      SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r,
        count(*) FILTER (fraud_indicator) OVER () AS p, count(*) FILTER (NOT fraud_indicator) OVER () AS n
      FROM scores) GROUP BY p, n),
    (SELECT sum(pos * tp_upto / upto) / sum(pos) AS ap FROM (
      SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp_upto, sum(c) OVER (ORDER BY s DESC) AS upto FROM (
        SELECT s, count(*) AS c, count(*) FILTER (fraud_indicator) AS pos FROM scores GROUP BY 1)))"""


def _rounded_metrics(out):
    rates = (
        "accuracy", "precision", "recall", "f1", "false_positive_rate", "roc_auc", "average_precision"
    )
    return out.withColumns({c: rounded(F.col(c)) for c in rates})


@registry.query(
    over_claims(_METRICS_SQL, *_SAVED, "scores AS (SELECT fraud_indicator, by_amount AS s FROM saved)")
)
def classification_metrics(spark, sf_dir):
    return _rounded_metrics(C.evaluate(materialise(saved_probabilities(spark, sf_dir)), "by_amount", LABEL))


@registry.query(
    over_claims(
        """SELECT model, accuracy, false_positive_rate, f1, accuracy >= 0.94::DOUBLE AS meets_accuracy,
        false_positive_rate <= 0.038::DOUBLE AS meets_fpr,
        accuracy >= 0.94::DOUBLE AND false_positive_rate <= 0.038::DOUBLE AS meets_targets,
        (SELECT model FROM compared ORDER BY f1 DESC, model DESC LIMIT 1) AS best_model FROM compared""",
        *_SAVED,
        *[f"scores_{c} AS (SELECT fraud_indicator, {c} AS s FROM saved)" for c in ("by_amount", "by_provider", "by_flags")],
        "compared AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS model, * FROM ({_METRICS_SQL.replace('FROM scores', f'FROM scores_{c}')})"
            for c in ("by_amount", "by_provider", "by_flags")
        )
        + ")",
    )
)
def target_check_and_best_model(spark, sf_dir):
    rows = materialise(saved_probabilities(spark, sf_dir))
    tables = None
    for name in ("by_amount", "by_provider", "by_flags"):
        found = _rounded_metrics(C.evaluate(rows, name, LABEL)).withColumn("model", F.lit(name))
        tables = found if tables is None else tables.unionByName(found)
    checked = C.target_check(materialise(tables))
    best = C.best_model(checked).first()["best_model"]
    return checked.select(
        "model", "accuracy", "false_positive_rate", "f1", "meets_accuracy", "meets_fpr", "meets_targets",
        F.lit(best).alias("best_model"),
    )


@registry.query()
def stratified_cross_validation(spark, sf_dir):
    rows = materialise(numeric_features(spark, sf_dir))
    return C.cross_validate(rows, "claim_id", "logistic_regression", NAMES, LABEL)


@registry.query()
def grid_search_by_auc(spark, sf_dir):
    rows = materialise(numeric_features(spark, sf_dir))
    _, scores = C.grid_search(rows, "claim_id", "logistic_regression", NAMES, LABEL)
    return scores


@registry.query()
def model_feature_importance(spark, sf_dir):
    rows = materialise(numeric_features(spark, sf_dir))
    tables = [
        C.model_importance(C.train(rows, name, NAMES, LABEL, **SMALLER[name]), NAMES)
        for name in ("random_forest", "gradient_boosting")
    ]
    return C.mean_importance(tables)


_MI = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, round(sum(CASE WHEN n > 0 THEN n / total * ln(n * total / (bin_n * y_n)) ELSE 0 END), 6)
      AS mutual_information FROM (SELECT n, sum(n) OVER (PARTITION BY bin) AS bin_n, sum(n) OVER (PARTITION BY y) AS y_n,
        sum(n) OVER () AS total FROM (SELECT fraud_indicator AS y,
          least(floor(({f} - lo) / (hi - lo) * 10), 9) AS bin, count(*) AS n FROM numeric_features,
          (SELECT min({f}) AS lo, max({f}) AS hi FROM numeric_features) WHERE {f} IS NOT NULL GROUP BY 1, 2))"""
    for f in ("billed_amount", "rendering_hours", "days_supply", "procedure_count", "red_flag_count")
)


@registry.query(over_claims(_MI, NUMERIC_SQL))
def mutual_information(spark, sf_dir):
    names = ["billed_amount", "rendering_hours", "days_supply", "procedure_count", "red_flag_count"]
    out = C.mutual_information(numeric_features(spark, sf_dir), names, LABEL)
    return out.withColumn("mutual_information", rounded(F.col("mutual_information")))


@registry.query(
    over_claims(
        """SELECT part, count(*) AS claims, round(avg(billed_amount), 4) AS billed_amount,
        round(avg(quantity), 4) AS quantity FROM split GROUP BY 1""",
        NUMERIC_SQL, _SPLIT,
    )
)
def common_split_columns(spark, sf_dir):
    rows = materialise(split(spark, sf_dir))
    parts = [rows.where(F.col("part") == p) for p in ("train", "validation", "test")]
    tables = [parts[0].select("part", "claim_id", "billed_amount", "quantity"), parts[1], parts[2].drop("days_supply")]
    shared = C.common_features(tables)
    together = tables[0].select(*shared)
    for t in tables[1:]:
        together = together.unionByName(t.select(*shared))
    return together.groupBy("part").agg(
        F.count(F.lit(1)).alias("claims"),
        rounded(F.avg("billed_amount"), 4).alias("billed_amount"),
        rounded(F.avg("quantity"), 4).alias("quantity"),
    )


@registry.query()
def saved_model_predictions(spark, sf_dir):
    rows = materialise(split(spark, sf_dir))
    path = scratch_path(spark)
    C.save(C.train(rows.where("part = 'train'"), "logistic_regression", NAMES, LABEL), path)
    return C.predict(C.load(path), rows.where("part = 'test'"), NAMES, "claim_id", [LABEL])

"""Preprocessing queries."""

from pyspark.sql import functions as F

from claimscope.functions.columns import or_empty, rounded
from claimscope.operators import preprocessing as P
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.registry import Registry
from claimscope.sources.tables import claims

registry = Registry()


def _epoch_days(column):
    return f"({column} - DATE '2020-01-01')::BIGINT"


def _date_parts(column):
    return f"""year({column}) AS {column}_year, month({column}) AS {column}_month, day({column}) AS {column}_day,
      (isodow({column}) - 1)::BIGINT AS {column}_weekday,
      CASE WHEN isodow({column}) >= 6 THEN 1 ELSE 0 END::BIGINT AS {column}_is_weekend,
      quarter({column}) AS {column}_quarter, {_epoch_days(column)} AS {column}_days_since_epoch"""


@registry.query(
    over_claims(
        """SELECT claim_id, round(ln(1 + billed_amount::DOUBLE), 6) AS amount_log,
        (billed_amount % 100 = 0)::BIGINT AS amount_rounded,
        CASE WHEN billed_amount <= 0 THEN NULL WHEN billed_amount <= 100 THEN 'low'
          WHEN billed_amount <= 500 THEN 'medium' WHEN billed_amount <= 1000 THEN 'high'
          WHEN billed_amount <= 5000 THEN 'very_high' ELSE 'extreme' END AS amount_bin FROM claims"""
    )
)
def amount_features(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "billed_amount")
    found = P.amount_features()
    found["amount_log"] = rounded(found["amount_log"])
    return rows.select("claim_id", *[c.alias(n) for n, c in found.items()])


@registry.query(
    over_claims(
        """SELECT claim_id, split_part(provider_id, '-', 2) AS provider_prefix,
        split_part(patient_id, '-', 2) AS patient_prefix,
        right(provider_npi, 1)::BIGINT AS npi_last_digit FROM claims"""
    )
)
def id_parts(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "provider_id", "patient_id", "provider_npi")
    return rows.select("claim_id", *[c.alias(n) for n, c in P.id_features().items()])


@registry.query(
    over_claims(
        "SELECT claim_id, " + ", ".join(map(_date_parts, ("date_of_service", "accident_date", "fill_date")))
        + " FROM claims"
    )
)
def date_parts(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "date_of_service", "accident_date", "fill_date")
    parts = {}
    for column in ("date_of_service", "accident_date", "fill_date"):
        parts.update(P.date_features(column))
    return rows.select("claim_id", *[c.alias(n) for n, c in parts.items()])


@registry.query(
    over_claims("SELECT claim_id, date_of_service - accident_date AS days_accident_to_service FROM claims")
)
def accident_to_service_days(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "date_of_service", "accident_date")
    return rows.select("claim_id", P.days_to_service().alias("days_accident_to_service"))


_NPI_STATS = """npi AS (SELECT provider_npi, count(*) AS provider_claim_count,
  sum(billed_amount)::DOUBLE / count(billed_amount) AS provider_avg_amount,
  stddev_samp(billed_amount::DOUBLE) AS provider_amount_std, sum(billed_amount)::DOUBLE AS provider_total_amount,
  avg(fraud_indicator::INTEGER) AS provider_fraud_rate FROM claims WHERE provider_npi IS NOT NULL GROUP BY 1)"""


@registry.query(
    over_claims(
        """SELECT claim_id, provider_claim_count, provider_avg_amount,
        round(provider_amount_std, 4) AS provider_amount_std,
        round(provider_total_amount, 2) AS provider_total_amount,
        round(provider_fraud_rate, 6) AS provider_fraud_rate,
        round(provider_fraud_rate * 0.4
          + provider_avg_amount / (SELECT max(provider_avg_amount) FROM npi) * 0.3
          + provider_claim_count / (SELECT max(provider_claim_count) FROM npi) * 0.3, 6) AS provider_risk_score,
        coalesce(starts_with(provider_npi, '9999999'), false)::BIGINT AS provider_suspicious_npi,
        coalesce(contains(provider_id, 'FRAUD') OR contains(provider_id, 'TEST'), false)::BIGINT
          AS provider_test_id
        FROM claims LEFT JOIN npi USING (provider_npi)""",
        _NPI_STATS,
    )
)
def provider_profiles(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "provider_id", "provider_npi", "billed_amount", "fraud_indicator")
    return P.provider_profile(rows).select(
        "claim_id", "provider_claim_count",
        "provider_avg_amount",
        rounded(F.col("provider_amount_std"), 4).alias("provider_amount_std"),
        rounded(F.col("provider_total_amount"), 2).alias("provider_total_amount"),
        rounded(F.col("provider_fraud_rate")).alias("provider_fraud_rate"),
        rounded(F.col("provider_risk_score")).alias("provider_risk_score"),
        "provider_suspicious_npi", "provider_test_id",
    )


@registry.query(
    over_claims(
        """SELECT claim_id, (a <= q25)::BIGINT AS amount_below_25th, (a >= q90)::BIGINT AS amount_above_90th,
        (a >= q95)::BIGINT AS amount_above_95th, round((a - m) / s, 6) AS amount_zscore,
        (abs((a - m) / s) > 3)::BIGINT AS amount_outlier
        FROM (SELECT claim_id, billed_amount::DOUBLE AS a FROM claims),
          (SELECT quantile_cont(billed_amount::DOUBLE, 0.25) AS q25, quantile_cont(billed_amount::DOUBLE, 0.9) AS q90,
            quantile_cont(billed_amount::DOUBLE, 0.95) AS q95, avg(billed_amount::DOUBLE) AS m,
            stddev_samp(billed_amount::DOUBLE) AS s FROM claims)"""
    )
)
def amount_positions(spark, sf_dir):
    found = P.amount_position(claims(spark, sf_dir, "claim_id", "billed_amount"))
    return found.drop("billed_amount").withColumn("amount_zscore", rounded(F.col("amount_zscore")))


@registry.query(
    over_claims(
        """SELECT claim_id, (coalesce(len(diagnosis_codes), 0) > 1)::BIGINT AS multiple_diagnoses,
        (coalesce(len(procedure_codes), 0) > 5)::BIGINT AS many_procedures,
        round(coalesce(len(procedure_codes), 0) / (coalesce(len(diagnosis_codes), 0) + 1), 6)
          AS procedure_to_diagnosis_ratio,
        (service_location = '23')::BIGINT AS emergency_service, (service_location = '11')::BIGINT AS office_service,
        coalesce(days_supply > 30, false)::BIGINT AS long_supply,
        coalesce(days_supply > 90, false)::BIGINT AS excessive_supply,
        coalesce(quantity > 100, false)::BIGINT AS high_quantity FROM claims"""
    )
)
def claim_shape_flags(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "diagnosis_codes", "procedure_codes", "service_location",
        "days_supply", "quantity",
    )
    found = P.shape_flags()
    found["procedure_to_diagnosis_ratio"] = rounded(found["procedure_to_diagnosis_ratio"])
    return rows.select("claim_id", *[c.alias(n) for n, c in found.items()])


_NUMERIC = ["rendering_hours", "quantity", "days_supply"]
_CATEGORICAL = ["claim_type", "provider_specialty"]
_MEDIANS = "medians AS (SELECT " + ", ".join(
    f"median({c}::DOUBLE) AS {c}_median" for c in _NUMERIC
) + " FROM claims)"
_MODES = "modes AS (SELECT " + ", ".join(
    f"(SELECT {c} FROM claims WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}_mode"
    for c in _CATEGORICAL
) + ")"


def _inputs(spark, sf_dir, numeric, categorical):
    return claims(spark, sf_dir, "claim_id", *numeric, *categorical)


@registry.query(
    over_claims(
        "SELECT claim_id, "
        + ", ".join(f"coalesce({c}::DOUBLE, {c}_median) AS {c}" for c in _NUMERIC) + " FROM claims, medians",
        _MEDIANS,
    )
)
def median_imputation(spark, sf_dir):
    rows = _inputs(spark, sf_dir, _NUMERIC, [])
    return P.Preprocessor(_NUMERIC, []).fit(rows).impute(rows)


@registry.query(
    over_claims(
        "SELECT claim_id, " + ", ".join(f"coalesce({c}, {c}_mode) AS {c}" for c in _CATEGORICAL)
        + " FROM claims, modes",
        _MODES,
    )
)
def mode_imputation(spark, sf_dir):
    rows = _inputs(spark, sf_dir, [], _CATEGORICAL)
    return P.Preprocessor([], _CATEGORICAL).fit(rows).impute(rows)


@registry.query(
    over_claims(
        "SELECT claim_id, "
        + ", ".join(
            f"(claim_type = '{v}')::BIGINT AS claim_type_{v}"
            for v in ("institutional", "no_fault", "pharmacy", "professional")
        )
        + ", (service_location = '23')::BIGINT AS service_location_23 FROM claims"
    )
)
def one_hot_encoding(spark, sf_dir):
    rows = _inputs(spark, sf_dir, [], ["claim_type", "service_location"])
    fitted = P.Preprocessor([], ["claim_type", "service_location"]).fit(rows)
    return fitted.one_hot(rows).drop("claim_type", "service_location")


@registry.query(
    over_claims(
        """SELECT claim_id, t.code AS claim_type_code, s.code AS provider_specialty_code FROM claims
        LEFT JOIN (SELECT claim_type, row_number() OVER (ORDER BY claim_type) - 1 AS code
          FROM (SELECT DISTINCT claim_type FROM claims)) t USING (claim_type)
        LEFT JOIN (SELECT provider_specialty, row_number() OVER (ORDER BY provider_specialty) - 1 AS code
          FROM (SELECT DISTINCT provider_specialty FROM claims WHERE provider_specialty IS NOT NULL)) s
          USING (provider_specialty)"""
    )
)
def label_encoding(spark, sf_dir):
    rows = _inputs(spark, sf_dir, [], _CATEGORICAL)
    return P.Preprocessor([], _CATEGORICAL).fit(rows).label_encode(rows).drop(*_CATEGORICAL)


_IDENTITIES = ["patient_id", "provider_id"]


def _places(columns: list[str]) -> list[str]:
    return [
        f"{c}_places AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS place "
        f"FROM (SELECT DISTINCT {c} FROM claims WHERE {c} IS NOT NULL))"
        for c in columns
    ]


@registry.query(
    over_claims(
        """SELECT claim_id, p.place AS patient_id_code, q.place AS provider_id_code FROM claims
        LEFT JOIN patient_id_places p USING (patient_id) LEFT JOIN provider_id_places q USING (provider_id)""",
        *_places(_IDENTITIES),
    )
)
def label_encoding_of_identities(spark, sf_dir):
    rows = _inputs(spark, sf_dir, [], _IDENTITIES)
    return P.Preprocessor([], _IDENTITIES, wide_categories=0).fit(rows).label_encode(rows).drop(*_IDENTITIES)


@registry.query(
    over_claims(
        " UNION ALL ".join(
            f"SELECT claim_id, '{c}' AS feature, place FROM claims JOIN {c}_places USING ({c}) WHERE place > 0"
            for c in ("claim_type", *_IDENTITIES)
        ),
        *_places(["claim_type", *_IDENTITIES]),
    )
)
def one_hot_entries(spark, sf_dir):
    columns = ["claim_type", *_IDENTITIES]
    rows = _inputs(spark, sf_dir, [], columns)
    return P.one_hot_entries(rows, "claim_id", P.value_places(rows, columns), columns)


@registry.query(
    over_claims(
        """SELECT claim_id, place - 1 AS provider_id_hot FROM claims LEFT JOIN places
          ON coalesce(claims.provider_id, (SELECT provider_id FROM places ORDER BY n DESC, provider_id LIMIT 1))
            = places.provider_id AND place > 0
        WHERE date_of_service >= '1998-07-01'""",
        """places AS (SELECT provider_id, n, row_number() OVER (ORDER BY provider_id) - 1 AS place FROM (
          SELECT provider_id, count(*) AS n FROM claims
          WHERE provider_id IS NOT NULL AND date_of_service < '1998-07-01' GROUP BY 1))""",
    )
)
def fitted_identities_on_new_claims(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "date_of_service", "provider_id")
    earlier, later = rows.where("date_of_service < '1998-07-01'"), rows.where("date_of_service >= '1998-07-01'")
    return P.Preprocessor([], ["provider_id"], wide_categories=0).fit(earlier).transform(later, ["claim_id"])


_FILLED = "filled AS (SELECT claim_id, date_of_service, claim_type, " + ", ".join(
    f"coalesce({c}::DOUBLE, {c}_median) AS {c}" for c in _NUMERIC
) + " FROM claims, medians)"
_SCALES = "scales AS (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _NUMERIC
) + " FROM filled)"


@registry.query(
    over_claims(
        "SELECT claim_id, "
        + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}_scaled" for c in _NUMERIC) + " FROM filled, scales",
        _MEDIANS, _FILLED, _SCALES,
    )
)
def standard_scaling(spark, sf_dir):
    rows = _inputs(spark, sf_dir, _NUMERIC, [])
    fitted = P.Preprocessor(_NUMERIC, []).fit(rows)
    scaled = fitted.scale(fitted.impute(rows))
    return scaled.select("claim_id", *[rounded(F.col(f"{c}_scaled")).alias(f"{c}_scaled") for c in _NUMERIC])


_TRAINED = "DATE '1998-07-01'"


@registry.query(
    over_claims(
        "SELECT claim_id, "
        + ", ".join(
            f"round((coalesce({c}::DOUBLE, {c}_median) - {c}_m) / {c}_s, 6) AS {c}_scaled" for c in _NUMERIC
        )
        + ", "
        + ", ".join(
            f"(claim_type = '{v}')::BIGINT AS claim_type_{v}"
            for v in ("institutional", "no_fault", "pharmacy", "professional")
        )
        + f" FROM claims, medians, scales WHERE date_of_service >= {_TRAINED}",
        _MEDIANS.replace("FROM claims", f"FROM claims WHERE date_of_service < {_TRAINED}"),
        _FILLED,
        _SCALES.replace("FROM filled", f"FROM filled WHERE date_of_service < {_TRAINED}"),
    )
)
def fitted_preprocessing_on_new_claims(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "date_of_service", "claim_type", *_NUMERIC)
    earlier, later = rows.where("date_of_service < '1998-07-01'"), rows.where("date_of_service >= '1998-07-01'")
    out = P.Preprocessor(_NUMERIC, ["claim_type"]).fit(earlier).transform(later, ["claim_id"])
    return out.withColumns({f"{c}_scaled": rounded(F.col(f"{c}_scaled")) for c in _NUMERIC})


FEATURES = {
    "billed_amount": ("billed_amount::DOUBLE", lambda: F.col("billed_amount").cast("double")),
    "amount_log": ("ln(1 + billed_amount::DOUBLE)", lambda: F.log1p(F.col("billed_amount").cast("double"))),
    "rendering_hours": ("rendering_hours", lambda: F.col("rendering_hours")),
    "quantity": ("quantity::DOUBLE", lambda: F.col("quantity").cast("double")),
    "days_supply": ("days_supply::DOUBLE", lambda: F.col("days_supply").cast("double")),
    "procedure_count": (
        "coalesce(len(procedure_codes), 0)::DOUBLE",
        lambda: F.size(or_empty("procedure_codes")).cast("double"),
    ),
    "diagnosis_count": (
        "coalesce(len(diagnosis_codes), 0)::DOUBLE",
        lambda: F.size(or_empty("diagnosis_codes")).cast("double"),
    ),
    "red_flag_count": ("len(red_flags)::DOUBLE", lambda: F.size(or_empty("red_flags")).cast("double")),
}


def numeric_features(spark, sf_dir, *more):
    """The numeric claim features used by the statistics and model queries, and the label."""
    rows = claims(
        spark, sf_dir, "claim_id", "fraud_indicator", "billed_amount", "rendering_hours", "quantity",
        "days_supply", "procedure_codes", "diagnosis_codes", "red_flags", *more,
    )
    return rows.select(
        "claim_id", "fraud_indicator", *more, *[build().alias(n) for n, (_, build) in FEATURES.items()]
    )


NUMERIC_SQL = (
    "numeric_features AS (SELECT claim_id, fraud_indicator, date_of_service, "
    + ", ".join(f"{sql} AS {n}" for n, (sql, _) in FEATURES.items()) + " FROM claims)"
)


@registry.query(
    over_claims(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS feature, round(coalesce(abs(corr({n}, fraud_indicator::INTEGER)), 0), 6) AS correlation,
            round(avg({n}), 4) AS mean, round(stddev_samp({n}), 4) AS std, min({n}) AS min, max({n}) AS max,
            round(avg(({n} IS NULL)::INTEGER) * 100, 6) AS missing_pct FROM rounded_features"""
            for n in FEATURES
        ),
        NUMERIC_SQL,
        "rounded_features AS (SELECT * REPLACE (round(amount_log, 6) AS amount_log) FROM numeric_features)",
    )
)
def feature_profiles(spark, sf_dir):
    rows = numeric_features(spark, sf_dir).withColumn("amount_log", rounded(F.col("amount_log")))
    out = P.feature_profile(rows, list(FEATURES), "fraud_indicator")
    return out.withColumns(
        {
            "correlation": rounded(F.col("correlation")), "mean": rounded(F.col("mean"), 4),
            "std": rounded(F.col("std"), 4), "missing_pct": rounded(F.col("missing_pct")),
        }
    )


_IMPORTANCE = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(coalesce(abs(corr({n}, fraud_indicator::INTEGER)), 0), 6) AS importance "
    "FROM numeric_features"
    for n in FEATURES
)


@registry.query(over_claims(_IMPORTANCE, NUMERIC_SQL))
def feature_label_correlation(spark, sf_dir):
    out = P.label_correlation(numeric_features(spark, sf_dir), list(FEATURES), "fraud_indicator")
    return out.withColumn("importance", rounded(F.col("importance")))


@registry.query(over_claims(f"SELECT * FROM ({_IMPORTANCE}) ORDER BY importance DESC, feature LIMIT 3", NUMERIC_SQL))
def top_features(spark, sf_dir):
    found = P.label_correlation(numeric_features(spark, sf_dir), list(FEATURES), "fraud_indicator")
    return P.top_features(found, 3).withColumn("importance", rounded(F.col("importance")))

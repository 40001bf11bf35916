"""Missing-data queries."""

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import joined
from claimscope.operators import missing as M
from claimscope.plans.claims_sql import case_map, in_list, over_claims
from claimscope.plans.registry import Registry
from claimscope.sources.tables import CLAIM_COLUMNS, claims

registry = Registry()

_COLUMNS = [c for c in CLAIM_COLUMNS if c != "note_id"]
_LISTS = {"diagnosis_codes", "procedure_codes", "red_flags"}
_TEXTS = {
    "claim_id", "patient_id", "provider_npi", "provider_id", "claim_type", "provider_specialty",
    "service_location", "day_of_week", "time_of_service",
}


def _absent(field):
    if field not in _COLUMNS:
        return "true"
    if field in _LISTS:
        return f"({field} IS NULL OR len({field}) = 0)"
    if field in _TEXTS:
        return f"({field} IS NULL OR trim({field}) = '')"
    return f"({field} IS NULL)"


_ITEMS = [f"CASE WHEN {_absent(f)} THEN '{f}' END" for f in K.REQUIRED_FIELDS]
for _type, _fields in K.CONDITIONAL_FIELDS.items():
    _ITEMS += [
        f"CASE WHEN coalesce(claim_type, 'professional') = '{_type}' AND {_absent(f)} THEN '{f}' END" for f in _fields
    ]
for _f in M.IMPORTANT_FIELDS:
    _only = " AND claim_type = 'pharmacy'" if _f == "days_supply" else ""
    _ITEMS.append(f"CASE WHEN {_absent(_f)}{_only} THEN '{_f}' END")

_WEIGHT = (
    f"round(CASE WHEN f IN {in_list(K.REQUIRED_FIELDS)} THEN least(1.1::DOUBLE * ({{0}}), 1.0) ELSE {{0}} END, 2)"
).format(case_map("f", {k: f"{v}::DOUBLE" for k, v in K.CRITICALITY.items()}, "0.5::DOUBLE"))

_MISSING = (
    "gaps AS (SELECT *, list_sort(list_distinct(list_filter(["
    + ", ".join(_ITEMS)
    + "], lambda x: x IS NOT NULL))) AS missing FROM claims)"
)
_ALL = list(dict.fromkeys([*M.IMPORTANT_FIELDS, *K.REQUIRED_FIELDS]))


def _rows(spark, sf_dir):
    return claims(spark, sf_dir, *_COLUMNS)


@registry.query(
    over_claims(
        "SELECT claim_id, "
        + ", ".join(f"NOT {_absent(f)} AS has_{f}" for f in K.CRITICALITY if f in _COLUMNS)
        + " FROM claims"
    )
)
def field_presence(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fields = [f for f in K.CRITICALITY if f in _COLUMNS]
    return rows.select("claim_id", *[M.is_present(rows, f).alias(f"has_{f}") for f in fields])


@registry.query(over_claims("SELECT claim_id, array_to_string(missing, '|') AS missing FROM gaps", _MISSING))
def missing_fields(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("claim_id", joined(F.array_sort(M.missing_fields(rows))).alias("missing"))


@registry.query(
    over_claims(
        f"SELECT claim_id, f AS field, {_WEIGHT} AS criticality FROM (SELECT claim_id, unnest(missing) AS f FROM gaps)",
        _MISSING,
    )
)
def missing_field_criticality(spark, sf_dir):
    rows = M.with_missing(_rows(spark, sf_dir)).select("claim_id", F.explode("missing").alias("field"))
    return rows.withColumn("criticality", M.criticality(F.col("field")))


@registry.query(
    over_claims(
        "SELECT claim_id, round(("
        + " + ".join(f"({_absent(f)})::INTEGER" for f in _ALL)
        + f") / {len(_ALL)}, 3) AS missing_share FROM claims"
    )
)
def missing_data_share(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("claim_id", M.missing_share(rows).alias("missing_share"))


PROVIDER_PATTERN = [
    _MISSING,
    "npi_sizes AS (SELECT provider_npi, count(*) AS claim_count FROM claims WHERE provider_npi IS NOT NULL GROUP BY 1)",
    """npi_fields AS (SELECT provider_npi, f, count(*) AS claims_missing
      FROM (SELECT provider_npi, unnest(missing) AS f FROM gaps WHERE provider_npi IS NOT NULL) GROUP BY 1, 2)""",
    f"""npi_rates AS (SELECT provider_npi, claim_count, coalesce(sum(claims_missing), 0) / (claim_count * {M.CHECKED_PER_CLAIM}) AS rate,
      coalesce(sum((claims_missing / claim_count > 0.5)::INTEGER), 0)::BIGINT AS systematic
      FROM npi_sizes LEFT JOIN npi_fields USING (provider_npi) GROUP BY 1, 2)""",
    """provider_patterns AS (SELECT provider_npi, claim_count, round(rate, 3) AS missing_rate, systematic AS systematic_fields,
      round(CASE WHEN systematic > 0 THEN least(least(rate * 3, 1) + systematic * 0.15::DOUBLE, 1) ELSE least(rate * 3, 1) END, 3)
        AS suspicious_score FROM npi_rates)""",
]


@registry.query(over_claims("SELECT * FROM provider_patterns", *PROVIDER_PATTERN))
def provider_submission_pattern(spark, sf_dir):
    return M.provider_pattern(_rows(spark, sf_dir))


@registry.query(over_claims("SELECT provider_npi, f AS field, claims_missing FROM npi_fields", *PROVIDER_PATTERN[:3]))
def provider_missing_fields(spark, sf_dir):
    return M.missing_by_field(_rows(spark, sf_dir).where("provider_npi IS NOT NULL"), "provider_npi")


_PATIENT = f"""patient_patterns AS (SELECT patient_id, claim_count, round(rate, 3) AS missing_rate,
  round(CASE WHEN rate > 0.2::DOUBLE THEN least(rate * 2.5, 1) ELSE 0 END, 3) AS suspicious_score FROM (
    SELECT patient_id, count(*) AS claim_count, sum(len(missing)) / (count(*) * {M.CHECKED_FOR_PATIENT}) AS rate
    FROM gaps GROUP BY 1))"""


@registry.query(over_claims("SELECT * FROM patient_patterns", _MISSING, _PATIENT))
def patient_submission_pattern(spark, sf_dir):
    return M.patient_pattern(_rows(spark, sf_dir))


@registry.query(
    over_claims(
        """SELECT provider_npi, part, value, count(*) AS claims FROM (
          SELECT provider_npi, 'weekday' AS part, (isodow(submission_timestamp) - 1)::BIGINT AS value FROM claims
          UNION ALL SELECT provider_npi, 'hour', hour(submission_timestamp)::BIGINT FROM claims)
        WHERE provider_npi IS NOT NULL GROUP BY 1, 2, 3"""
    )
)
def submission_histograms(spark, sf_dir):
    return M.submission_histograms(claims(spark, sf_dir, "provider_npi", "submission_timestamp"))


_ODD = """isodow(submission_timestamp) >= 6 AS is_weekend,
  hour(submission_timestamp) < 6 OR hour(submission_timestamp) > 22 AS is_night_time"""


@registry.query(
    over_claims(
        f"""SELECT *, is_weekend OR is_night_time AS temporal_anomaly FROM (SELECT claim_id,
        (isodow(submission_timestamp) - 1)::BIGINT AS day_of_week, hour(submission_timestamp)::BIGINT AS hour, {_ODD}
        FROM claims)"""
    )
)
def submission_timing(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "submission_timestamp")
    return rows.select("claim_id", *[c.alias(n) for n, c in M.submission_timing().items()])


@registry.query(
    over_claims(
        f"""SELECT claim_id, len(factors)::BIGINT AS factor_count, round(CASE WHEN len(factors) = 0 THEN 0
          WHEN len(list_filter(factors, lambda x: x >= 0.4::DOUBLE)) = 0 THEN list_avg(factors) * 0.8
          WHEN len(factors) >= 3 AND list_avg(factors) > 0.5::DOUBLE THEN least(list_avg(factors) * 1.15, 1)
          ELSE list_avg(factors) END, 3) AS suspicion
        FROM (SELECT claim_id, list_filter([p.suspicious_score, q.suspicious_score,
            CASE WHEN len(missing) > 0 THEN list_avg(list_transform(missing, lambda f: {_WEIGHT})) END,
            CASE WHEN isodow(submission_timestamp) >= 6 OR hour(submission_timestamp) < 6
              OR hour(submission_timestamp) > 22 THEN 0.6::DOUBLE END], lambda x: x IS NOT NULL) AS factors
          FROM gaps LEFT JOIN provider_patterns p USING (provider_npi) LEFT JOIN patient_patterns q USING (patient_id))""",
        *PROVIDER_PATTERN, _PATIENT,
    )
)
def submission_suspicion(spark, sf_dir):
    return M.submission_suspicion(_rows(spark, sf_dir))

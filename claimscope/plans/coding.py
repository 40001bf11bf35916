"""Queries of the checks against reference tables."""

from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import joined, or_empty, rounded
from claimscope.operators import coding as D
from claimscope.operators.rules import expected_amount
from claimscope.plans.claims_sql import case_map, over_claims, text_list
from claimscope.plans.registry import Registry
from claimscope.sources.tables import claims, table

registry = Registry()

_DIGIT = "substr('80840' || provider_npi, i::INTEGER, 1)::INTEGER"


@registry.query(
    over_claims(
        f"""SELECT claim_id, coalesce(list_sum(list_transform(range(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGIT}
          WHEN {_DIGIT} * 2 > 9 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END)) % 10 = 0, false) AS npi_valid FROM claims"""
    )
)
def npi_checksum(spark, sf_dir):
    return claims(spark, sf_dir, "claim_id", "provider_npi").select("claim_id", D.npi_is_valid().alias("npi_valid"))


@registry.query(
    over_claims(
        r"""SELECT claim_id,
        array_to_string(list_filter(coalesce(diagnosis_codes, []), lambda c: NOT regexp_full_match(c, '[A-Z]\d{2}(\.\d{1,4})?')), '|')
          AS bad_diagnoses,
        array_to_string(list_filter(coalesce(procedure_codes, []), lambda c: NOT regexp_full_match(c, '\d{5}|\d{4}[A-Z]')), '|')
          AS bad_procedures FROM claims"""
    )
)
def code_formats(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "diagnosis_codes", "procedure_codes")
    return rows.select(
        "claim_id",
        joined(D.malformed("diagnosis_codes", K.ICD10_PATTERN)).alias("bad_diagnoses"),
        joined(D.malformed("procedure_codes", K.CPT_PATTERN)).alias("bad_procedures"),
    )


_EXPECTED = f"""coalesce(list_sum(list_transform(procedure_codes,
  lambda c: {case_map("c", K.FEE_SCHEDULE, K.DEFAULT_FEE)})), 0)"""


@registry.query(
    over_claims(
        f"""SELECT claim_id, unnest(list_filter([
          CASE WHEN submission_timestamp::DATE < accident_date THEN 'service_after_claim' END,
          CASE WHEN submission_timestamp::DATE - accident_date > 730 THEN 'service_too_old' END,
          CASE WHEN date_of_service < accident_date THEN 'range_reversed' END,
          CASE WHEN date_of_service - accident_date > 90 THEN 'range_too_long' END,
          CASE WHEN {_EXPECTED} > billed_amount THEN 'allowed_over_billed' END], lambda x: x IS NOT NULL)) AS "check"
        FROM claims"""
    )
)
def cross_field_checks(spark, sf_dir):
    rows = claims(
        spark, sf_dir, "claim_id", "submission_timestamp", "accident_date", "date_of_service",
        "billed_amount", "procedure_codes",
    )
    return D.cross_field_findings(
        rows.select(
            "claim_id", "billed_amount",
            F.col("submission_timestamp").cast("date").alias("claim_date"),
            F.col("accident_date").alias("service_date_from"),
            F.col("date_of_service").alias("service_date_to"),
            expected_amount(or_empty("procedure_codes")).alias("allowed_amount"),
        )
    )


# a small fixed table: the codes of a bundle, and office with emergency visits
_PAIRS = [
    (a, b, "bundled") for codes in K.BUNDLES.values() for a in codes for b in codes if a < b
] + [(a, b, "exclusive") for a in ("99213", "99214", "99215") for b in K.ER_CODES]


@registry.query(
    over_claims(
        """SELECT claim_id, kind, code, other FROM (SELECT claim_id, procedure_codes, unnest(procedure_codes) AS code
        FROM claims) JOIN pairs USING (code) WHERE list_contains(procedure_codes, other)""",
        "pairs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in _PAIRS)
        + ") t(code, other, kind))",
    )
)
def bundled_and_exclusive_pairs(spark, sf_dir):
    pairs = spark.createDataFrame(_PAIRS, "code string, other string, kind string")
    return D.listed_pairs(claims(spark, sf_dir, "claim_id", "procedure_codes"), pairs)


_POOL = text_list(K.PROCEDURE_POOL)


def _pool(index):
    return F.element_at(F.array(*[F.lit(c) for c in K.PROCEDURE_POOL]), (index % len(K.PROCEDURE_POOL) + 1).cast("int"))


@registry.query(
    over_claims(
        """SELECT claim_id, code, other, effective FROM (
          SELECT claim_id, code, other, max(effective) AS effective,
            arg_max(modifier_allowed, (effective, modifier_allowed)) AS allowed, any_value(service_location) AS place
          FROM (SELECT *, unnest(procedure_codes) AS code FROM claims) JOIN edits USING (code)
          WHERE list_contains(procedure_codes, other) AND code <> other AND effective <= date_of_service
            AND (deleted IS NULL OR deleted > date_of_service) GROUP BY 1, 2, 3)
        WHERE NOT (allowed AND place = '23')""",
        f"""edits AS (SELECT {_POOL}[p_partkey % 40 + 1] AS code, {_POOL}[(p_partkey * 7) % 40 + 1] AS other,
          make_date((1995 + p_partkey % 6)::INTEGER, 1, 1) AS effective,
          max(CASE WHEN p_partkey % 3 > 0 THEN make_date((1996 + p_partkey % 6)::INTEGER, 1, 1) END) AS deleted,
          bool_or(p_partkey % 2 = 0) AS modifier_allowed FROM part GROUP BY 1, 2, 3)""",
    )
)
def pair_edits_in_force(spark, sf_dir):
    p = F.col("p_partkey")
    edits = (
        table(spark, sf_dir, "part")
        .groupBy(
            _pool(p).alias("code"), _pool(p * 7).alias("other"),
            F.make_date((p % 6 + 1995).cast("int"), F.lit(1), F.lit(1)).alias("effective"),
        )
        .agg(
            F.max(F.when(p % 3 > 0, F.make_date((p % 6 + 1996).cast("int"), F.lit(1), F.lit(1)))).alias("deleted"),
            F.bool_or(p % 2 == 0).alias("modifier_allowed"),
        )
    )
    rows = claims(spark, sf_dir, "claim_id", "date_of_service", "service_location", "procedure_codes")
    modifiers = F.when(F.col("service_location") == "23", F.array(F.lit("59"))).otherwise(F.array().cast("array<string>"))
    return D.pair_edits(rows.withColumn("modifiers", modifiers), edits)


@registry.query(
    f"""SELECT claim, code, units, max_units FROM (SELECT l_orderkey AS claim, {_POOL}[l_partkey % 40 + 1] AS code,
      sum(l_quantity::BIGINT)::BIGINT AS units FROM lineitem GROUP BY 1, 2)
    JOIN (SELECT code, (20 + place)::BIGINT AS max_units FROM (SELECT unnest({_POOL}) AS code,
      generate_subscripts({_POOL}, 1) AS place) WHERE place <= 30) USING (code) WHERE units > max_units"""
)
def units_over_limit(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim"), _pool(F.col("l_partkey")).alias("code"),
        F.col("l_quantity").cast("long").alias("units"),
    )
    limits = spark.createDataFrame(
        [(c, 21 + i) for i, c in enumerate(K.PROCEDURE_POOL[:30])], "code string, max_units long"
    )
    return D.units_over_limit(units, limits)


# a small fixed table: two diagnoses for each of the first thirty procedures
_COVERAGE = [
    (c, [K.DIAGNOSIS_POOL[i % 16], K.DIAGNOSIS_POOL[(i + 5) % 16]]) for i, c in enumerate(K.PROCEDURE_POOL[:30])
]


@registry.query(
    over_claims(
        """SELECT claim_id, code FROM (SELECT claim_id, diagnosis_codes, unnest(procedure_codes) AS code FROM claims)
        JOIN coverage USING (code) WHERE NOT list_has_any(diagnosis_codes, diagnoses)""",
        "coverage AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {text_list(d)})" for c, d in _COVERAGE)
        + ") t(code, diagnoses))",
    )
)
def uncovered_procedures(spark, sf_dir):
    coverage = spark.createDataFrame(_COVERAGE, "code string, diagnoses array<string>")
    return D.uncovered_procedures(claims(spark, sf_dir, "claim_id", "diagnosis_codes", "procedure_codes"), coverage)


@registry.query(
    over_claims(
        f"""SELECT claim_id, unnest(list_filter([
          CASE WHEN submission_timestamp::DATE - date_of_service > 2 THEN 'TIMELY_FILING' END,
          CASE WHEN {_EXPECTED} > 0 AND billed_amount > {_EXPECTED} * 3 THEN 'EXCESSIVE_BILLING' END],
          lambda x: x IS NOT NULL)) AS rule FROM claims"""
    )
)
def filing_and_billing_checks(spark, sf_dir):
    rows = claims(spark, sf_dir, "claim_id", "submission_timestamp", "date_of_service", "billed_amount", "procedure_codes")
    prepared = rows.select(
        "claim_id", "date_of_service", "billed_amount",
        F.col("submission_timestamp").cast("date").alias("claim_date"),
        expected_amount(or_empty("procedure_codes")).alias("expected_amount"),
    )
    return D.filing_findings(prepared, max_days=2)


_QUALITY = [
    f"""checked AS (SELECT claim_id, provider_npi IS NOT NULL AS has_npi, procedure_codes IS NOT NULL AS has_codes,
      (6 + (provider_npi IS NOT NULL)::INTEGER + (procedure_codes IS NOT NULL)::INTEGER
        - (diagnosis_codes IS NULL)::INTEGER) AS present,
      (fill_date IS NOT NULL)::INTEGER + 1 AS extras,
      ((accident_date <= date_of_service)::INTEGER + (billed_amount > 0 AND billed_amount <= 10000)::INTEGER
        + (procedure_codes IS NOT NULL)::INTEGER + (NOT coalesce(contains(provider_id, 'FRAUD'), true))::INTEGER) / 4
        AS consistency,
      ((provider_npi IS NOT NULL)::INTEGER + (procedure_codes IS NOT NULL)::INTEGER
        + (NOT (billed_amount > {_EXPECTED} * 3))::INTEGER) / 3 AS accuracy,
      CASE WHEN submission_timestamp::DATE - date_of_service <= 1 THEN 1 ELSE 0.5 END::DOUBLE AS timeliness
      FROM claims)""",
    """quality AS (SELECT *, present / 8 * 0.8::DOUBLE + extras / 5 * 0.2::DOUBLE AS completeness FROM checked)""",
    """scored_quality AS (SELECT *, completeness * 0.3 + consistency * 0.25 + accuracy * 0.25 + timeliness * 0.2 AS score
      FROM quality)""",
]


def quality_rows(spark, sf_dir):
    """Claims with the four quality factors, from fields these tables have."""
    rows = claims(
        spark, sf_dir, "claim_id", "patient_id", "provider_id", "provider_npi", "diagnosis_codes", "procedure_codes",
        "submission_timestamp", "date_of_service", "billed_amount", "fill_date", "accident_date",
    )
    required = [
        F.col(c).isNotNull()
        for c in (
            "claim_id", "patient_id", "provider_npi", "diagnosis_codes", "procedure_codes",
            "submission_timestamp", "date_of_service", "billed_amount",
        )
    ]
    optional = [F.col("fill_date").isNotNull(), F.lit(True), F.lit(False), F.lit(False), F.lit(False)]

    def share(checks):
        return sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0)) / len(checks)

    expected = expected_amount(or_empty("procedure_codes"))
    coded = F.col("procedure_codes").isNotNull()
    consistency = share(
        [
            F.col("accident_date") <= F.col("date_of_service"),
            (F.col("billed_amount") > 0) & (F.col("billed_amount") <= 10000),
            coded,
            ~F.col("provider_id").contains("FRAUD"),
        ]
    )
    accuracy = share([F.col("provider_npi").isNotNull(), coded, ~(F.col("billed_amount") > expected * 3)])
    delay = F.datediff(F.col("submission_timestamp").cast("date"), "date_of_service")
    return rows.select(
        "claim_id", F.col("provider_npi").isNotNull().alias("has_npi"), coded.alias("has_codes"),
        D.completeness(required, optional).alias("completeness"),
        consistency.alias("consistency"), accuracy.alias("accuracy"),
        F.when(delay <= 1, 1.0).otherwise(0.5).alias("timeliness"),
    ).withColumn(
        "score",
        D.quality_score(F.col("completeness"), F.col("consistency"), F.col("accuracy"), F.col("timeliness")),
    )


@registry.query(
    over_claims(
        """SELECT claim_id, round(completeness, 6) AS completeness, round(score, 6) AS score,
        CASE WHEN round(score, 6) >= 0.95::DOUBLE THEN 'EXCELLENT' WHEN round(score, 6) >= 0.85::DOUBLE THEN 'GOOD'
          WHEN round(score, 6) >= 0.7::DOUBLE THEN 'ACCEPTABLE' WHEN round(score, 6) >= 0.5::DOUBLE THEN 'POOR'
          ELSE 'CRITICAL' END AS tier FROM scored_quality""",
        *_QUALITY,
    )
)
def data_quality_scores(spark, sf_dir):
    return quality_rows(spark, sf_dir).select(
        "claim_id", rounded(F.col("completeness")).alias("completeness"), rounded(F.col("score")).alias("score"),
        D.quality_tier(rounded(F.col("score"))).alias("tier"),
    )


@registry.query(
    over_claims(
        """SELECT claim_id, n = 4 AS ready, n / 4 AS confidence, array_to_string(list_filter([
          CASE WHEN NOT good THEN 'quality_score' END, CASE WHEN NOT has_npi THEN 'required_fields' END,
          CASE WHEN NOT has_codes THEN 'enrichment_available' END, CASE WHEN accuracy <= 0.5::DOUBLE THEN 'validation_passed' END],
          lambda x: x IS NOT NULL), '|') AS blockers,
        CASE WHEN n = 4 THEN 'PROCEED_TO_FRAUD_DETECTION' WHEN accuracy <= 0.5::DOUBLE THEN 'REJECT_INVALID_DATA'
          WHEN NOT has_codes THEN 'RETRY_ENRICHMENT' WHEN NOT good THEN 'MANUAL_REVIEW_REQUIRED'
          ELSE 'ADDITIONAL_DATA_NEEDED' END AS recommendation
        FROM (SELECT *, round(score, 6) >= 0.7::DOUBLE AS good, (round(score, 6) >= 0.7::DOUBLE)::INTEGER + has_npi::INTEGER
          + has_codes::INTEGER + (accuracy > 0.5::DOUBLE)::INTEGER AS n FROM scored_quality)""",
        *_QUALITY,
    )
)
def readiness_gate(spark, sf_dir):
    checks = {
        "quality_score": rounded(F.col("score")) >= 0.70,
        "required_fields": F.col("has_npi"),
        "enrichment_available": F.col("has_codes"),
        "validation_passed": F.col("accuracy") > 0.5,
    }
    found = D.readiness(checks)
    found["blockers"] = joined(found["blockers"])
    return quality_rows(spark, sf_dir).select("claim_id", *[c.alias(n) for n, c in found.items()])

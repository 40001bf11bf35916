"""Checks of codes and claims against reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import or_empty, texts


def npi_is_valid(npi: str = "provider_npi") -> Column:
    """Luhn check of a ten-digit number behind its fixed prefix."""
    full = F.concat(F.lit(K.NPI_PREFIX), F.col(npi))
    places = F.sequence(F.lit(1), F.lit(len(K.NPI_PREFIX) + 10))

    def value(place: Column) -> Column:
        digit = F.substring(full, place, F.lit(1)).try_cast("int")
        doubled = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.col(npi).rlike(K.NPI_PATTERN) & (total % 10 == 0), F.lit(False))


def malformed(column: str, pattern: str) -> Column:
    """The codes of a list that do not have the expected form."""
    return F.filter(or_empty(column), lambda c: ~c.rlike(pattern))


def cross_field_findings(claims: DataFrame) -> DataFrame:
    """Contradictions between dates and between amounts.

    Reads claim_date, service_date_from, service_date_to, billed_amount and allowed_amount.
    """
    age = F.datediff("claim_date", "service_date_from")
    span = F.datediff("service_date_to", "service_date_from")
    checks = {
        "service_after_claim": age < 0,
        "service_too_old": age > 730,
        "range_reversed": span < 0,
        "range_too_long": span > 90,
        "allowed_over_billed": F.col("allowed_amount") > F.col("billed_amount"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return claims.select("claim_id", F.explode(found).alias("check"))


def listed_pairs(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """Claims holding both codes of a listed pair (bundled or mutually exclusive).

    ``pairs`` has (code, other, kind). The join is on the first code; the second is looked
    up in the claim's own list, so no pairs of a claim's codes are formed.
    """
    coded = claims.select("claim_id", "procedure_codes", F.explode("procedure_codes").alias("code"))
    return (
        coded.join(pairs, "code")
        .where(F.array_contains("procedure_codes", F.col("other")))
        .select("claim_id", "kind", "code", "other")
    )


def pair_edits(claims: DataFrame, edits: DataFrame) -> DataFrame:
    """Code pairs that may not be billed together at the service date.

    ``edits`` has (code, other, effective, deleted, modifier_allowed); of several edits in
    force the newest counts, and an override modifier lifts those that allow one.
    """
    coded = claims.select(
        "claim_id", "date_of_service", "modifiers", "procedure_codes", F.explode("procedure_codes").alias("code")
    )
    in_force = (F.col("effective") <= F.col("date_of_service")) & (
        F.col("deleted").isNull() | (F.col("deleted") > F.col("date_of_service"))
    )
    lifted = F.arrays_overlap("modifiers", texts(K.OVERRIDE_MODIFIERS))
    newest = (
        coded.join(edits, "code")
        .where(F.array_contains("procedure_codes", F.col("other")) & (F.col("code") != F.col("other")) & in_force)
        .groupBy("claim_id", "code", "other")
        .agg(
            F.max(F.struct("effective", "modifier_allowed")).alias("edit"),
            F.first(F.coalesce(lifted, F.lit(False))).alias("lifted"),
        )
    )
    return newest.where(~(F.col("edit.modifier_allowed") & F.col("lifted"))).select(
        "claim_id", "code", "other", F.col("edit.effective").alias("effective")
    )


def units_over_limit(units: DataFrame, limits: DataFrame) -> DataFrame:
    """Units per claim and code above the limit of the code; codes without one pass.

    ``units`` has (claim, code, units), ``limits`` (code, max_units).
    """
    totals = units.groupBy("claim", "code").agg(F.sum("units").alias("units"))
    return totals.join(limits, "code", "left").where(F.col("units") > F.col("max_units"))


def uncovered_procedures(claims: DataFrame, coverage: DataFrame) -> DataFrame:
    """Procedures with listed diagnoses of which the claim has none.

    ``coverage`` has (code, diagnoses).
    """
    coded = claims.select("claim_id", "diagnosis_codes", F.explode("procedure_codes").alias("code"))
    return (
        coded.join(coverage, "code")
        .where(~F.arrays_overlap(or_empty("diagnosis_codes"), "diagnoses"))
        .select("claim_id", "code")
    )


def filing_findings(claims: DataFrame, max_days: int = 365, max_ratio: float = 3.0) -> DataFrame:
    """Late filing and billing far over the expected amount.

    Reads claim_date, date_of_service, billed_amount and expected_amount.
    """
    checks = {
        "TIMELY_FILING": F.datediff("claim_date", "date_of_service") > max_days,
        "EXCESSIVE_BILLING": (F.col("expected_amount") > 0)
        & (F.col("billed_amount") > F.col("expected_amount") * max_ratio),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return claims.select("claim_id", F.explode(found).alias("rule"))


def completeness(required: list[Column], optional: list[Column]) -> Column:
    """Four fifths of the required and one fifth of the optional fields present."""

    def share(present: list[Column]) -> Column:
        return sum((F.when(p, 1).otherwise(0) for p in present), F.lit(0)) / len(present)

    return share(required) * 0.8 + share(optional) * 0.2


def quality_score(completeness: Column, consistency: Column, accuracy: Column, timeliness: Column) -> Column:
    return completeness * 0.30 + consistency * 0.25 + accuracy * 0.25 + timeliness * 0.20


def quality_tier(score: Column) -> Column:
    return (
        F.when(score >= 0.95, "EXCELLENT")
        .when(score >= 0.85, "GOOD")
        .when(score >= 0.70, "ACCEPTABLE")
        .when(score >= 0.50, "POOR")
        .otherwise("CRITICAL")
    )


def readiness(checks: dict[str, Column]) -> dict[str, Column]:
    """Gate, confidence, blockers and recommendation from the four readiness checks."""
    passed = [checks[n] for n in ("quality_score", "required_fields", "enrichment_available", "validation_passed")]
    count = sum((c.cast("int") for c in passed), F.lit(0))
    return {
        "ready": count == len(passed),
        "confidence": count / len(passed),
        "blockers": F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()])),
        "recommendation": F.when(count == len(passed), "PROCEED_TO_FRAUD_DETECTION")
        .when(~checks["validation_passed"], "REJECT_INVALID_DATA")
        .when(~checks["enrichment_available"], "RETRY_ENRICHMENT")
        .when(~checks["quality_score"], "MANUAL_REVIEW_REQUIRED")
        .otherwise("ADDITIONAL_DATA_NEEDED"),
    }

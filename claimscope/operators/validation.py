"""Validation of claims: per-row rules in one projection, batch rules as aggregations.

Every rule yields (claim_id, rule, field_name, error_message, severity).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import or_empty, texts
from claimscope.operators.routing import claim_kind


@dataclass(frozen=True)
class RowRule:
    """A predicate over one claim; ``columns`` are the claim columns it reads."""

    field: str
    severity: str
    columns: tuple[str, ...]
    fires: Callable[[str], Column]
    message: Callable[[str], Column]


def _says(text: str) -> Callable[[str], Column]:
    return lambda as_of: F.lit(text)


def _kind(name: str) -> Column:
    return claim_kind() == name


def _missing(field: str) -> RowRule:
    return RowRule(
        field, "error", (field,), lambda as_of: F.col(field).isNull(), _says("is a required property")
    )


def _pattern(field: str, pattern: str) -> RowRule:
    return RowRule(
        field, "error", (field,), lambda as_of: ~F.col(field).rlike(pattern),
        lambda as_of: F.concat(F.col(field), F.lit(" does not match the pattern")),
    )


def _no_items(field: str) -> RowRule:
    return RowRule(field, "error", (field,), lambda as_of: F.size(field) == 0, _says("has no items"))


SCHEMA_REQUIRED = [
    "claim_id", "patient_id", "provider_id", "provider_npi", "date_of_service",
    "diagnosis_codes", "procedure_codes", "billed_amount", "claim_type",
]

SCHEMA_RULES: dict[str, RowRule] = {
    **{f"missing_{field}": _missing(field) for field in SCHEMA_REQUIRED},
    "pattern_claim_id": _pattern("claim_id", K.CLAIM_ID_PATTERN),
    "pattern_patient_id": _pattern("patient_id", K.PATIENT_ID_PATTERN),
    "pattern_provider_id": _pattern("provider_id", K.PROVIDER_ID_PATTERN),
    "pattern_provider_npi": _pattern("provider_npi", K.NPI_PATTERN),
    "empty_diagnosis_codes": _no_items("diagnosis_codes"),
    "empty_procedure_codes": _no_items("procedure_codes"),
    "negative_billed_amount": RowRule(
        "billed_amount", "error", ("billed_amount",), lambda as_of: F.col("billed_amount") < 0,
        _says("is less than the minimum of 0"),
    ),
    "enum_claim_type": RowRule(
        "claim_type", "error", ("claim_type",),
        lambda as_of: ~F.col("claim_type").isin("professional", "institutional"),
        lambda as_of: F.concat(F.col("claim_type"), F.lit(" is not one of the medical claim types")),
    ),
}


def _days(start: str, end: str) -> Column:
    return F.datediff(F.col(end), F.col(start))


BUSINESS_RULES: dict[str, RowRule] = {
    "amount_over_daily_maximum": RowRule(
        "billed_amount", "warning", ("billed_amount",),
        lambda as_of: F.col("billed_amount") > K.MAX_DAILY_AMOUNT,
        lambda as_of: F.concat(
            F.lit("Amount $"), F.col("billed_amount").cast("string"),
            F.lit(f" exceeds daily maximum ${K.MAX_DAILY_AMOUNT}.00"),
        ),
    ),
    "round_amount": RowRule(
        "billed_amount", "warning", ("billed_amount",),
        lambda as_of: (F.col("billed_amount") % 100 == 0) & (F.col("billed_amount") >= 1000),
        _says("Suspicious round number billing amount"),
    ),
    "future_service_date": RowRule(
        "date_of_service", "error", ("date_of_service",),
        lambda as_of: F.col("date_of_service") > F.lit(as_of).cast("date"),
        _says("Service date is in the future"),
    ),
    "old_service_date": RowRule(
        "date_of_service", "warning", ("date_of_service",),
        lambda as_of: F.datediff(F.lit(as_of).cast("date"), "date_of_service") > 730,
        _says("Service date is over 2 years old"),
    ),
    "sunday_service": RowRule(
        "date_of_service", "warning", ("date_of_service", "claim_type"),
        lambda as_of: F.col("claim_type").isin("professional", "institutional")
        & (F.weekday("date_of_service") == 6),
        _says("Professional service on Sunday"),
    ),
    "suspicious_npi": RowRule(
        "provider_npi", "warning", ("provider_npi",),
        lambda as_of: F.col("provider_npi").startswith("9999999"),
        _says("Suspicious NPI pattern (starts with 9999999)"),
    ),
    "test_provider": RowRule(
        "provider_id", "warning", ("provider_id",),
        lambda as_of: F.col("provider_id").contains("FRAUD") | F.col("provider_id").contains("TEST"),
        _says("Test or fraud provider ID detected"),
    ),
    "too_many_procedures": RowRule(
        "procedure_codes", "warning", ("procedure_codes", "claim_type"),
        lambda as_of: _kind("medical") & (F.size("procedure_codes") > K.MAX_PROCEDURE_CODES),
        lambda as_of: F.concat(F.lit("Too many procedure codes: "), F.size("procedure_codes")),
    ),
    "many_procedures": RowRule(
        "procedure_codes", "warning", ("procedure_codes", "claim_type"),
        lambda as_of: _kind("medical") & (F.size("procedure_codes") > 5),
        _says("Potential unbundling - many procedure codes"),
    ),
    "emergency_code_for_routine_diagnosis": RowRule(
        "diagnosis_codes", "warning", ("diagnosis_codes", "procedure_codes", "claim_type"),
        lambda as_of: _kind("medical")
        & F.arrays_overlap("procedure_codes", texts(K.ER_CODES))
        & F.exists(
            "diagnosis_codes",
            lambda d: F.substring(d, 1, 3).isin(K.ROUTINE_PREFIXES),
        ),
        _says("Diagnosis codes may not match procedure codes"),
    ),
    "long_days_supply": RowRule(
        "days_supply", "warning", ("days_supply", "claim_type"),
        lambda as_of: _kind("pharmacy") & (F.col("days_supply") > 90),
        _says("Excessive days supply (>90 days)"),
    ),
    "large_quantity": RowRule(
        "quantity", "warning", ("quantity", "claim_type"),
        lambda as_of: _kind("pharmacy") & (F.col("quantity") > 1000),
        _says("Unusually high quantity"),
    ),
    "fill_date_differs": RowRule(
        "fill_date", "warning", ("fill_date", "date_of_service", "claim_type"),
        lambda as_of: _kind("pharmacy") & (F.col("fill_date") != F.col("date_of_service")),
        _says("Fill date differs from service date"),
    ),
    "accident_after_service": RowRule(
        "accident_date", "error", ("accident_date", "date_of_service", "claim_type"),
        lambda as_of: _kind("no_fault") & (F.col("accident_date") > F.col("date_of_service")),
        _says("Accident date is after service date"),
    ),
    "late_after_accident": RowRule(
        "date_of_service", "warning", ("accident_date", "date_of_service", "claim_type"),
        lambda as_of: _kind("no_fault") & (_days("accident_date", "date_of_service") > 365),
        lambda as_of: F.concat(
            F.lit("Service date is "), _days("accident_date", "date_of_service"),
            F.lit(" days after accident"),
        ),
    ),
}


def rule_columns(rules: Iterable[RowRule]) -> list[str]:
    """The claim columns a set of rules reads, ``claim_id`` first."""
    return list(dict.fromkeys(["claim_id", *[c for r in rules for c in r.columns]]))


def _findings_column(rules: dict[str, RowRule], as_of: str) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(
                    rule.fires(as_of),
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.lit(rule.field).alias("field_name"),
                        rule.message(as_of).alias("error_message"),
                        F.lit(rule.severity).alias("severity"),
                    ),
                )
                for name, rule in rules.items()
            ]
        )
    )


def row_findings(claims: DataFrame, rules: dict[str, RowRule], as_of: str) -> DataFrame:
    """All findings of a set of per-row rules from one scan.

    A single rule also filters the rows, which reaches the file scan.
    """
    if len(rules) == 1:
        claims = claims.where(next(iter(rules.values())).fires(as_of))
    return claims.select("claim_id", F.inline(_findings_column(rules, as_of)))


def schema_violations(claims: DataFrame) -> DataFrame:
    """Per claim with violations: how many, and the fields in question."""
    found = _findings_column(SCHEMA_RULES, "")
    return (
        claims.select("claim_id", found.alias("found"))
        .where(F.size("found") > 0)
        .select(
            "claim_id",
            F.size("found").cast("long").alias("violations"),
            F.concat_ws(
                "; ",
                F.transform(
                    "found", lambda e: F.concat(e["field_name"], F.lit(": "), e["error_message"])
                ),
            ).alias("errors"),
        )
    )


def label_inconsistencies(claims: DataFrame) -> DataFrame:
    """Claims flagged as fraud without a fraud type."""
    return claims.where(F.col("fraud_indicator") & F.col("fraud_type").isNull()).select(
        "claim_id",
        F.lit("fraud_type").alias("field_name"),
        F.lit("fraud_type is required when fraud_indicator is true").alias("error_message"),
        F.lit("error").alias("severity"),
    )


def _flags_mention(phrase: str) -> Column:
    return F.exists("red_flags", lambda flag: F.contains(F.lower(flag), F.lit(phrase.lower())))


def flag_phrase_findings(claims: DataFrame) -> DataFrame:
    """One finding per known phrase contained in any red flag, ignoring case."""
    phrases = [(family, phrase) for family, group in K.FLAG_PHRASES.items() for phrase in group]
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    _flags_mention(phrase),
                    F.struct(F.lit(family).alias("family"), F.lit(phrase).alias("phrase")),
                )
                for family, phrase in phrases
            ]
        )
    )
    return claims.select("claim_id", F.inline(hits)).select(
        "claim_id",
        "family",
        F.lit("red_flags").alias("field_name"),
        F.concat(F.lit("Known fraud pattern detected: "), F.col("phrase")).alias("error_message"),
        F.lit("warning").alias("severity"),
    )


def duplicate_claims(claims: DataFrame) -> DataFrame:
    """One error per claim id that occurs more than once."""
    return (
        claims.groupBy("claim_id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where("occurrences > 1")
        .withColumn("error_message", F.concat(F.lit("Duplicate claim ID found: "), F.col("claim_id")))
        .withColumn("severity", F.lit("error"))
    )


def busy_provider_days(claims: DataFrame, limit: int = K.MAX_PROVIDER_DAY) -> DataFrame:
    """Providers with more than ``limit`` claims on one date."""
    return (
        claims.where("provider_id IS NOT NULL AND date_of_service IS NOT NULL")
        .groupBy("provider_id", "date_of_service")
        .agg(F.count(F.lit(1)).alias("claim_count"))
        .where(F.col("claim_count") > limit)
        .withColumn(
            "error_message",
            F.concat(
                F.lit("Provider "), "provider_id", F.lit(" has "), "claim_count",
                F.lit(" claims on "), F.date_format("date_of_service", "yyyy-MM-dd"),
            ),
        )
    )


def fits_model(claims: DataFrame) -> Column:
    """Whether a row fits the typed record of its claim kind."""
    base = F.lit(True)
    for field in ("claim_id", "patient_id", "date_of_service", "billed_amount"):
        base = base & F.col(field).isNotNull()
    codes = (F.size(or_empty("diagnosis_codes")) > 0) & (F.size(or_empty("procedure_codes")) > 0)
    kind = claim_kind()
    return base & (F.col("billed_amount") >= 0) & kind.isNotNull() & ((kind != "medical") | codes)


def batch_summary(claims: DataFrame, as_of: str, provider_day_limit: int = K.MAX_PROVIDER_DAY) -> DataFrame:
    """Processed rows, errors and warnings of a batch; rows not fitting the model count one error.

    Business rules run only on rows that fit. Everything is counted with partial
    aggregation; the long finding table is never written.
    """
    found = _findings_column(BUSINESS_RULES, as_of)
    phrases = sum(
        (
            F.coalesce(_flags_mention(phrase), F.lit(False)).cast("long")
            for group in K.FLAG_PHRASES.values()
            for phrase in group
        ),
        F.lit(0),
    )

    def of(severity: str) -> Column:
        return F.size(F.filter("found", lambda e: e["severity"] == severity)).cast("long")

    per_row = claims.select(fits_model(claims).alias("fits"), found.alias("found"), phrases.alias("phrases"))
    totals = per_row.agg(
        F.count(F.lit(1)).alias("processed_count"),
        F.coalesce(F.sum(F.when(F.col("fits"), of("error")).otherwise(1)), F.lit(0)).alias("row_errors"),
        F.coalesce(F.sum(F.when(F.col("fits"), of("warning") + F.col("phrases"))), F.lit(0)).alias("row_warnings"),
    )
    duplicates = duplicate_claims(claims).agg(F.count(F.lit(1)).alias("duplicates"))
    busy = busy_provider_days(claims, provider_day_limit).agg(F.count(F.lit(1)).alias("busy_days"))
    parts = (
        totals.select(
            "processed_count", F.col("row_errors").alias("errors"), F.col("row_warnings").alias("warnings")
        )
        .unionByName(duplicates.selectExpr("0L AS processed_count", "duplicates AS errors", "0L AS warnings"))
        .unionByName(busy.selectExpr("0L AS processed_count", "0L AS errors", "busy_days AS warnings"))
    )
    return parts.agg(
        F.sum("processed_count").alias("processed_count"),
        F.sum("errors").alias("error_count"),
        F.sum("warnings").alias("warnings_count"),
    )

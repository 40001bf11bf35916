"""Routing, defaults and flattening of claim rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.columns import or_empty

REQUIRED_COLUMNS = ["claim_id", "provider_id", "patient_id", "date_of_service"]


def normalised_type(column: str = "claim_type") -> Column:
    return F.replace(F.col(column), F.lit("-"), F.lit("_"))


def claim_kind(column: str = "claim_type") -> Column:
    """medical, pharmacy or no_fault; null for an unknown type."""
    kind = normalised_type(column)
    return (
        F.when(kind.isin("professional", "institutional"), "medical")
        .when(kind == "pharmacy", "pharmacy")
        .when(kind.isin("no_fault", "auto"), "no_fault")
    )


def route(claims: DataFrame) -> DataFrame:
    return claims.withColumn("claim_kind", claim_kind())


def split_routed(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routed claims, and the claims of unknown type set aside."""
    routed = route(claims)
    return routed.where("claim_kind IS NOT NULL"), routed.where("claim_kind IS NULL")


def with_defaults(claims: DataFrame) -> DataFrame:
    """Amount 0 and empty code lists where missing; the key columns must exist."""
    absent = [c for c in REQUIRED_COLUMNS if c not in claims.columns]
    if absent:
        raise ValueError(f"Missing required columns: {absent}")
    return claims.withColumns(
        {
            "billed_amount": F.coalesce("billed_amount", F.lit(0)).cast("decimal(12,2)"),
            "procedure_codes": or_empty("procedure_codes"),
            "diagnosis_codes": or_empty("diagnosis_codes"),
        }
    )


def flatten(routed: DataFrame) -> DataFrame:
    """One wide row per claim; columns of other claim kinds stay null."""

    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("claim_kind") == kind, value)

    def counted(column: str) -> Column:
        return F.size(or_empty(column)).cast("long")

    return routed.select(
        "claim_id", "patient_id", "provider_id", "provider_npi", "date_of_service",
        F.col("billed_amount").cast("double").alias("billed_amount"),
        "claim_type", "fraud_indicator",
        counted("red_flags").alias("red_flags_count"),
        F.coalesce(F.length("notes") > 0, F.lit(False)).alias("has_notes"),
        only("medical", counted("diagnosis_codes")).alias("diagnosis_count"),
        only("medical", counted("procedure_codes")).alias("procedure_count"),
        only("medical", F.try_element_at("diagnosis_codes", F.lit(1))).alias("primary_diagnosis"),
        only("medical", F.try_element_at("procedure_codes", F.lit(1))).alias("primary_procedure"),
        only("medical", F.col("service_location")).alias("service_location"),
        only("medical", F.col("rendering_hours")).alias("rendering_hours"),
        only("medical", F.col("day_of_week")).alias("day_of_week"),
        only("pharmacy", F.col("quantity").cast("long")).alias("quantity"),
        only("pharmacy", F.col("days_supply").cast("long")).alias("days_supply"),
        only("pharmacy", F.col("fill_date")).alias("fill_date"),
        only("no_fault", F.col("accident_date")).alias("accident_date"),
    )


def claim_codes(claims: DataFrame) -> DataFrame:
    """One row per claim and code, from both code lists."""
    lists = F.map_from_arrays(
        F.array(F.lit("procedure"), F.lit("diagnosis")),
        F.array(or_empty("procedure_codes"), or_empty("diagnosis_codes")),
    )
    return claims.select("claim_id", F.explode(lists).alias("code_kind", "codes")).select(
        "claim_id", "code_kind", F.explode("codes").alias("code")
    )

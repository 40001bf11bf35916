"""Fraud signals from submission habits and enrichment outcomes.

Every signal is (subject, signal_type, signal_strength) with strengths to 3 decimals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import lookup


def capped(value: Column) -> Column:
    return F.least(F.lit(1.0), value.cast("double"))


def incomplete_submissions(patterns: DataFrame) -> DataFrame:
    """Strength from the provider's missing rate and systematically missing fields."""
    base = capped(F.col("missing_rate") * 1.5)
    raised = F.when(F.col("systematic_fields") > 0, capped(base + F.col("systematic_fields") * 0.10)).otherwise(base)
    return patterns.select(
        F.col("provider_npi").alias("subject"),
        F.lit("provider_incomplete_submissions").alias("signal_type"),
        F.round(raised, 3).alias("signal_strength"),
    )


def _signal(rows: DataFrame, subject: str, name: str, strength: Column) -> DataFrame:
    return rows.select(
        F.col(subject).cast("string").alias("subject"),
        F.lit(name).alias("signal_type"),
        F.round(strength.cast("double"), 3).alias("signal_strength"),
    )


def enrichment_failure(rows: DataFrame, subject: str, failed_below: float = 0.5) -> DataFrame:
    """Enrichments that failed; a confidence of zero weighs more."""
    strength = F.when(F.col("confidence") == 0, 0.60).otherwise(0.50)
    return _signal(rows.where(F.col("confidence") < failed_below), subject, "enrichment_failure", strength)


def low_confidence(rows: DataFrame, subject: str) -> DataFrame:
    gap = F.greatest(F.lit(0.0), F.lit(0.60) - F.col("confidence"))
    return _signal(rows, subject, "low_enrichment_confidence", capped(gap * 2.0))


def coding_violation(rows: DataFrame, subject: str) -> DataFrame:
    strength = lookup(F.col("severity"), {k: F.lit(v) for k, v in K.VIOLATION_STRENGTH.items()}, F.lit(0.60))
    return _signal(rows, subject, "invalid_medical_combination", strength)


def inconsistent_history(claims: DataFrame) -> DataFrame:
    """Share of a claim's codes met in under 10 % of the provider's claims."""
    known = claims.where("provider_id IS NOT NULL")
    sizes = known.groupBy("provider_id").agg(F.count(F.lit(1)).alias("history"))
    coded = known.select("claim_id", "provider_id", F.explode("procedure_codes").alias("code"))
    frequency = coded.groupBy("provider_id", "code").agg(F.count(F.lit(1)).alias("seen"))
    rare = (
        coded.join(frequency, ["provider_id", "code"])
        .join(sizes, "provider_id")
        .groupBy("claim_id")
        .agg(F.avg((F.col("seen") / F.col("history") < 0.10).cast("double")).alias("share"))
    )
    strength = F.when(F.col("share").isNotNull(), capped(F.col("share") * 0.80)).otherwise(0.40)
    return _signal(claims.join(rare, "claim_id", "left"), "claim_id", "inconsistent_enrichment", strength)


def unusual_source(rows: DataFrame, subject: str) -> DataFrame:
    """Rarely used source reached by fallbacks, measured against the provider's habits."""
    shares = rows.groupBy("provider", "source").agg(F.count(F.lit(1)).alias("n"))
    totals = shares.groupBy("provider").agg(F.sum("n").alias("all"))
    typical = shares.join(totals, "provider").select(
        "provider", "source", (F.col("n") / F.col("all")).alias("typical_rate")
    )
    fallbacks = F.col("fallback_count")
    strength = (
        F.when((F.col("typical_rate") < 0.10) & (fallbacks > 0), capped(0.50 + fallbacks * 0.10))
        .when(fallbacks >= 3, capped(fallbacks * 0.15))
        .otherwise(0.30)
    )
    return _signal(rows.join(typical, ["provider", "source"], "left"), subject, "unusual_enrichment_source", strength)


def enrichment_complexity(rows: DataFrame, subject: str) -> DataFrame:
    base = capped((F.col("attempts") - 1) * 0.15)
    strength = F.when(F.col("strategy") == "default", capped(base + 0.25)).otherwise(base)
    return _signal(rows, subject, "high_enrichment_complexity", strength)


def aggregate_signals(signals: list[DataFrame]) -> DataFrame:
    """Count, strongest, mean, sum and severe signals per subject, and their types."""
    together = reduce(DataFrame.unionByName, signals)
    strength = F.col("signal_strength")
    per_type = together.groupBy("subject", "signal_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(strength).alias("top"),
        F.sum(strength.cast("decimal(20,3)")).alias("total"),
        F.sum((strength >= 0.70).cast("long")).alias("severe"),
    )
    return per_type.groupBy("subject").agg(
        F.sum("n").alias("signal_count"),
        F.max("top").alias("max_strength"),
        (F.sum("total").cast("double") / F.sum("n")).alias("avg_strength"),
        F.sum("total").cast("double").alias("total_strength"),
        F.sum("severe").alias("high_severity_count"),
        F.concat_ws("|", F.array_sort(F.collect_set("signal_type"))).alias("signal_types"),
    )

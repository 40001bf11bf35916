"""Confidence in enrichment decisions, from five factors of the evidence."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K


def retrieval_quality(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Half relevance, three tenths closeness, two tenths number of results (best from 3)."""
    score = (
        F.avg("relevance") * 0.50
        + F.greatest(F.lit(0.0), 1 - F.avg("distance")) * 0.30
        + F.least(F.lit(1.0), F.count(F.lit(1)) / 3) * 0.20
    )
    return evidence.groupBy(*by).agg(F.round(score, 4).alias("retrieval_quality"))


def source_diversity(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sources over the number of known sources."""
    share = F.count_distinct("source") / len(K.KNOWLEDGE_SOURCES)
    return evidence.groupBy(*by).agg(F.round(share, 4).alias("source_diversity"))


def temporal_relevance(age: Column) -> Column:
    """Decay with a half-life of 120 days; a negative age is an error."""
    decay = F.round(F.exp(-age * math.log(2) / K.HALF_LIFE_DAYS), 4)
    return F.when(age < 0, F.raise_error(F.lit("age_days cannot be negative")).cast("double")).otherwise(decay)


def cross_validation(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of the values per field, averaged over the fields."""
    values = evidence.groupBy(*by, "field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    ratio = F.max("n") / F.sum("n")
    score = (
        F.when(F.sum("n") == 1, 0.50)
        .when(ratio == 1, 1.0)
        .when(ratio >= 0.75, 0.85)
        .when(ratio >= 0.50, 0.70)
        .otherwise(0.40)
    )
    fields = values.groupBy(*by, "field_name").agg(score.alias("agreement"))
    mean = F.sum(F.col("agreement").cast("decimal(20,2)")).cast("double") / F.count(F.lit(1))
    return fields.groupBy(*by).agg(F.round(mean, 4).alias("cross_validation"))


def regulatory_citation(confirmed: Column, confidence: Column) -> Column:
    return (
        F.when(confirmed, F.round(confidence * 0.25 + 0.75, 4)).when(confidence > 0.70, 0.20).otherwise(0.50)
    )


def overall_confidence() -> Column:
    """Weighted sum of the five factor columns, between 0 and 1; exact to the last decimal."""
    total = sum(
        (
            F.coalesce(F.col(name), F.lit(0.0)).cast("decimal(8,4)") * F.lit(Decimal(f"{w:.2f}"))
            for name, w in K.FACTOR_WEIGHTS.items()
        ),
        F.lit(0),
    )
    return F.round(F.greatest(F.lit(0), F.least(F.lit(1), total)), 4).cast("double")


def quality_tier(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.90, "excellent")
        .when(confidence >= 0.80, "good")
        .when(confidence >= 0.70, "acceptable")
        .otherwise("poor")
    )


def all_factors(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The five factors, overall confidence and tier per group.

    The regulatory factor takes the best relevance among regulatory evidence; it confirms
    when such evidence exists.
    """
    regulatory = F.max(F.when(F.col("source") == "regulatory", F.col("relevance")))
    rest = evidence.groupBy(*by).agg(
        F.min("age_days").alias("age_days"), regulatory.alias("regulatory_relevance")
    )
    confirmed = F.col("regulatory_relevance").isNotNull()
    return (
        retrieval_quality(evidence, by)
        .join(source_diversity(evidence, by), by)
        .join(cross_validation(evidence, by), by)
        .join(rest, by)
        .withColumn("temporal_relevance", temporal_relevance(F.col("age_days")))
        .withColumn(
            "regulatory_citation",
            regulatory_citation(confirmed, F.coalesce("regulatory_relevance", F.lit(0.0))),
        )
        .withColumn("confidence", overall_confidence())
        .withColumn("tier", quality_tier(F.col("confidence")))
        .drop("age_days", "regulatory_relevance")
    )

"""Confidence queries over enrichment evidence."""

from pyspark.sql import functions as F

from claimscope.operators import confidence as C
from claimscope.plans.registry import Registry
from claimscope.plans.signals import over_enrichments
from claimscope.sources.enrichments import enrichments

registry = Registry()

_EVIDENCE = """evidence AS (SELECT claim, field_name, source, enriched_value AS value, confidence AS relevance,
  distance, age_days FROM enrichments)"""
_RETRIEVAL = """retrieval AS (SELECT claim, round(avg(relevance) * 0.5 + greatest(0, 1 - avg(distance)) * 0.3
  + least(1, count(*) / 3) * 0.2, 4) AS retrieval_quality FROM evidence GROUP BY 1)"""
_DIVERSITY = "diversity AS (SELECT claim, round(count(DISTINCT source) / 4, 4) AS source_diversity FROM evidence GROUP BY 1)"
_CROSS = """crossed AS (SELECT claim, round(sum(agreement)::DOUBLE / count(*), 4) AS cross_validation FROM (
  SELECT claim, field_name, (CASE WHEN sum(n) = 1 THEN 0.5 WHEN max(n) = sum(n) THEN 1 WHEN max(n) / sum(n) >= 0.75 THEN 0.85
    WHEN max(n) / sum(n) >= 0.5 THEN 0.7 ELSE 0.4 END)::DECIMAL(20,2) AS agreement FROM (
      SELECT claim, field_name, value, count(*) AS n FROM evidence GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)"""
_REST = """rest AS (SELECT claim, round(exp(-min(age_days) * ln(2) / 120), 4) AS temporal_relevance,
  coalesce(round(max(relevance) FILTER (source = 'regulatory') * 0.25 + 0.75, 4), 0.5) AS regulatory_citation
  FROM evidence GROUP BY 1)"""
_OVERALL = """SELECT *, CASE WHEN confidence >= 0.9::DOUBLE THEN 'excellent' WHEN confidence >= 0.8::DOUBLE THEN 'good'
    WHEN confidence >= 0.7::DOUBLE THEN 'acceptable' ELSE 'poor' END AS tier
  FROM (SELECT claim, retrieval_quality, source_diversity, cross_validation, temporal_relevance, regulatory_citation,
    round(greatest(0, least(1, retrieval_quality::DECIMAL(8,4) * 0.4 + source_diversity::DECIMAL(8,4) * 0.2
      + temporal_relevance::DECIMAL(8,4) * 0.15 + cross_validation::DECIMAL(8,4) * 0.15
      + regulatory_citation::DECIMAL(8,4) * 0.1)), 4)::DOUBLE AS confidence
    FROM retrieval JOIN diversity USING (claim) JOIN crossed USING (claim) JOIN rest USING (claim))"""


def evidence(spark, sf_dir):
    return enrichments(spark, sf_dir).select(
        "claim", "field_name", "source", F.col("enriched_value").alias("value"),
        F.col("confidence").alias("relevance"), "distance", "age_days",
    )


@registry.query(over_enrichments("SELECT * FROM retrieval", _EVIDENCE, _RETRIEVAL))
def retrieval_quality(spark, sf_dir):
    return C.retrieval_quality(evidence(spark, sf_dir), ["claim"])


@registry.query(over_enrichments("SELECT * FROM diversity", _EVIDENCE, _DIVERSITY))
def source_diversity(spark, sf_dir):
    return C.source_diversity(evidence(spark, sf_dir), ["claim"])


@registry.query(
    over_enrichments(
        "SELECT enrichment_id, round(exp(-age_days * ln(2) / 120), 4) AS temporal_relevance FROM enrichments"
    )
)
def temporal_relevance(spark, sf_dir):
    rows = enrichments(spark, sf_dir)
    return rows.select("enrichment_id", C.temporal_relevance(F.col("age_days")).alias("temporal_relevance"))


@registry.query(over_enrichments("SELECT * FROM crossed", _EVIDENCE, _CROSS))
def cross_validation(spark, sf_dir):
    return C.cross_validation(evidence(spark, sf_dir), ["claim"])


@registry.query(
    over_enrichments(
        """SELECT enrichment_id, CASE WHEN source = 'regulatory' THEN round(confidence * 0.25 + 0.75, 4)
        WHEN confidence > 0.7::DOUBLE THEN 0.2 ELSE 0.5 END::DOUBLE AS regulatory_citation FROM enrichments"""
    )
)
def regulatory_citation(spark, sf_dir):
    score = C.regulatory_citation(F.col("source") == "regulatory", F.col("confidence"))
    return enrichments(spark, sf_dir).select("enrichment_id", score.alias("regulatory_citation"))


_ALL = [_EVIDENCE, _RETRIEVAL, _DIVERSITY, _CROSS, _REST]


@registry.query(over_enrichments(f"SELECT claim, confidence FROM ({_OVERALL})", *_ALL))
def overall_confidence(spark, sf_dir):
    return C.all_factors(evidence(spark, sf_dir), ["claim"]).select("claim", "confidence")


@registry.query(over_enrichments(_OVERALL, *_ALL))
def confidence_factors_and_tier(spark, sf_dir):
    return C.all_factors(evidence(spark, sf_dir), ["claim"])

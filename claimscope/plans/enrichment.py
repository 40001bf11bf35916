"""Enrichment metric queries."""

from pyspark.sql import functions as F

from claimscope.functions.columns import rounded
from claimscope.operators import enrichment as E
from claimscope.plans.registry import Registry
from claimscope.plans.signals import over_enrichments
from claimscope.sources.enrichments import enrichments

registry = Registry()

# the known value of every third claim is 0, of the others 1 or 2
_ACTUAL = "claim % 3"


def _decided(spark, sf_dir):
    return enrichments(spark, sf_dir).withColumn("actual_value", F.col("claim") % 3)


def _accuracy(by):
    return over_enrichments(
        f"SELECT {by}, round(avg((enriched_value = {_ACTUAL})::INTEGER), 6) AS accuracy FROM enrichments GROUP BY 1"
    )


@registry.query(_accuracy("field_name"))
def field_accuracy(spark, sf_dir):
    return E.accuracy_by(_decided(spark, sf_dir), "field_name").withColumn("accuracy", rounded(F.col("accuracy")))


@registry.query(_accuracy("source"))
def source_accuracy(spark, sf_dir):
    return E.accuracy_by(_decided(spark, sf_dir), "source").withColumn("accuracy", rounded(F.col("accuracy")))


@registry.query(
    over_enrichments("SELECT round(avg((confidence >= 0.7::DOUBLE)::INTEGER), 6) AS coverage FROM enrichments")
)
def enrichment_coverage(spark, sf_dir):
    return E.coverage(enrichments(spark, sf_dir)).withColumn("coverage", rounded(F.col("coverage")))


_CUTS = ", ".join(
    f"quantile_cont(latency_ms, {p}) AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
)


@registry.query(
    over_enrichments(
        f"SELECT round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM (SELECT {_CUTS} FROM enrichments)"
    )
)
def latency_percentiles(spark, sf_dir):
    out = E.latency_percentiles(enrichments(spark, sf_dir))
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


@registry.query(
    over_enrichments(
        f"""SELECT total_enrichments, average_confidence, average_latency_ms, coverage, round(p50, 2) AS p50_latency_ms,
        round(p95, 2) AS p95_latency_ms, round(p99, 2) AS p99_latency_ms FROM (
          SELECT count(*) AS total_enrichments, round(avg(confidence), 4) AS average_confidence,
            round(avg(latency_ms), 2) AS average_latency_ms,
            round(avg((confidence >= 0.7::DOUBLE)::INTEGER), 4) AS coverage, {_CUTS} FROM enrichments)"""
    )
)
def enrichment_report(spark, sf_dir):
    return E.metrics_report(enrichments(spark, sf_dir))


_REUSE = """marked AS (SELECT enrichment_id, sha256('{"field_name":"' || field_name || '","provider":' || provider || '}')
    AS request_key, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 86400000000, false) AS hit
  FROM enrichments WINDOW w AS (PARTITION BY provider, field_name ORDER BY ts, enrichment_id))"""


def _marked(spark, sf_dir):
    return E.with_reuse(enrichments(spark, sf_dir), ["provider", "field_name"], "ts", "enrichment_id")


@registry.query(over_enrichments("SELECT enrichment_id, request_key, hit FROM marked", _REUSE))
def request_reuse(spark, sf_dir):
    return _marked(spark, sf_dir).select("enrichment_id", "request_key", "hit")


@registry.query(
    over_enrichments(
        """SELECT count(*) AS requests, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 6) AS hit_rate
        FROM marked""",
        _REUSE,
    )
)
def request_hit_rate(spark, sf_dir):
    return E.hit_rate(_marked(spark, sf_dir)).withColumn("hit_rate", rounded(F.col("hit_rate")))


@registry.query(
    over_enrichments(
        """SELECT count(*) AS total, count(*) FILTER (confidence >= 0.7::DOUBLE) AS successful,
        count(*) FILTER (confidence < 0.7::DOUBLE) AS failed, round(avg(latency_ms), 6) AS avg_time_ms FROM enrichments"""
    )
)
def batch_outcomes(spark, sf_dir):
    return E.batch_outcomes(enrichments(spark, sf_dir)).withColumn("avg_time_ms", rounded(F.col("avg_time_ms")))

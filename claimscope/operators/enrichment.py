"""Enrichment metrics: accuracy, coverage, latency, outcomes and reuse of equal requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.functions.skew import GROUP_LIMIT, over_recent, quantiles

ACCEPTABLE = 0.70


def accuracy_by(decisions: DataFrame, by: str) -> DataFrame:
    """Share of decisions equal to the known value, per field or per source."""
    hit = F.coalesce(F.col("enriched_value") == F.col("actual_value"), F.lit(False))
    return decisions.groupBy(by).agg(F.avg(hit.cast("double")).alias("accuracy"))


def coverage(decisions: DataFrame) -> DataFrame:
    """Share of decisions with acceptable confidence; 0 when there are none."""
    share = F.avg((F.col("confidence") >= ACCEPTABLE).cast("double"))
    return decisions.agg(F.coalesce(share, F.lit(0.0)).alias("coverage"))


def latency_percentiles(decisions: DataFrame, column: str = "latency_ms") -> DataFrame:
    """p50, p95 and p99 with linear interpolation; 0 when there are none."""
    cuts = quantiles(decisions, {column: [0.5, 0.95, 0.99]})[column]
    row = [F.lit(float(cuts[p] or 0.0)).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return decisions.sparkSession.range(1).select(*row)


def metrics_report(decisions: DataFrame) -> DataFrame:
    """Totals, mean confidence and latency, percentiles and coverage in one row."""
    totals = decisions.agg(
        F.count(F.lit(1)).alias("total_enrichments"),
        F.round(F.avg("confidence"), 4).alias("average_confidence"),
        F.round(F.avg("latency_ms"), 2).alias("average_latency_ms"),
        F.round(F.avg((F.col("confidence") >= ACCEPTABLE).cast("double")), 4).alias("coverage"),
    )
    cuts = quantiles(decisions, {"latency_ms": [0.5, 0.95, 0.99]})["latency_ms"]
    return totals.select(
        "*",
        *[F.round(F.lit(cuts[p]), 2).alias(f"{n}_latency_ms") for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))],
    )


def request_key(columns: list[str]) -> Column:
    """SHA-256 of the request as JSON with sorted keys; missing values count as null."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def with_reuse(
    requests: DataFrame, columns: list[str], time: str, tie: str, hours: int = 24, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Mark requests whose equal predecessor lies at most ``hours`` back.

    Every hit renews the entry, so only the previous equal request matters.
    """
    keyed = requests.withColumn("request_key", request_key(columns))
    paired = over_recent(
        keyed, ["request_key"], [time, tie], 2,
        lambda frame: {
            "previous": F.first(time).over(frame),
            "frame_rows": F.count(F.lit(1)).over(frame),
        },
        limit,
    )
    near = F.unix_micros(time) - F.unix_micros("previous") <= hours * 3600 * 1_000_000
    return paired.withColumn("hit", (F.col("frame_rows") > 1) & near).drop("previous", "frame_rows")


def hit_rate(marked: DataFrame) -> DataFrame:
    return marked.agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("hit").cast("long")).alias("hits"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
    )


def batch_outcomes(decisions: DataFrame) -> DataFrame:
    """Total, successful and failed enrichments and mean time."""
    good = (F.col("confidence") >= ACCEPTABLE).cast("long")
    return decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(good).alias("successful"),
        F.sum(1 - good).alias("failed"),
        F.avg("latency_ms").alias("avg_time_ms"),
    )

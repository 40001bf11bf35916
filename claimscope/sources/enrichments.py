"""Enrichment records read from the ``events`` table.

One event is one enrichment of one field of a claim: the user is the claim's provider, the
event type names the field, ``value`` is the latency and ``props.k`` the confidence in
percent. The remaining columns are derived from those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.constants import KNOWLEDGE_SOURCES
from claimscope.functions.columns import texts
from claimscope.sources.tables import table


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.element_at(texts(KNOWLEDGE_SOURCES), (F.col("event_id") % 4 + 1).cast("int"))
    severity = F.element_at(texts(["low", "medium", "high", "critical"]), k % 4 + 1)
    return events.select(
        F.col("event_id").alias("enrichment_id"),
        F.col("user_id").alias("provider"),
        (F.col("event_id") % 997).alias("claim"),
        F.col("event_type").alias("field_name"),
        source.alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        (k / 100).alias("confidence"),
        F.col("value").alias("latency_ms"),
        (F.col("value") / 500).alias("distance"),
        F.datediff(F.lit("2024-12-31").cast("date"), F.col("ts").cast("date")).alias("age_days"),
        (k % 3).cast("long").alias("enriched_value"),
        (k % 4).alias("fallback_count"),
        (k % 6 + 1).alias("attempts"),
        F.when(k % 7 == 0, "default").otherwise("pattern").alias("strategy"),
        severity.alias("severity"),
    )

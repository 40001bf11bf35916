"""Feature families over the whole claims table, each keyed by claim_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope import constants as K
from claimscope.functions.columns import as_flag, count_in, lookup, mean_of, or_empty
from claimscope.functions.skew import (
    GROUP_LIMIT,
    over_recent,
    quantiles,
    with_average_rank,
    with_sequence,
    with_sorted_code,
)
from claimscope.operators.graph import graph_features
from claimscope.operators.text import text_features

NO_PREVIOUS = 999


def amount() -> Column:
    return F.coalesce(F.col("billed_amount").cast("double"), F.lit(0.0))


def procedure_complexity() -> Column:
    scores = F.transform(
        or_empty("procedure_codes"),
        lambda c: lookup(c, K.COMPLEXITY, K.DEFAULT_COMPLEXITY).cast("double"),
    )
    return mean_of(scores)


def diagnosis_severity() -> Column:
    scores = F.transform(
        or_empty("diagnosis_codes"),
        lambda c: lookup(F.substring(c, 1, 3), K.SEVERITY, K.DEFAULT_SEVERITY).cast("double"),
    )
    return mean_of(scores)


def basic_features(claims: DataFrame) -> DataFrame:
    px, dx = F.size(or_empty("procedure_codes")), F.size(or_empty("diagnosis_codes"))
    return claims.select(
        "claim_id",
        amount().alias("billed_amount"),
        F.log1p(amount()).alias("billed_amount_log"),
        F.sqrt(amount()).alias("billed_amount_sqrt"),
        px.cast("long").alias("num_procedure_codes"),
        dx.cast("long").alias("num_diagnosis_codes"),
        (px + dx).cast("long").alias("total_codes"),
        procedure_complexity().alias("avg_procedure_complexity"),
        diagnosis_severity().alias("diagnosis_severity"),
        (amount() / (px + 1)).alias("amount_per_procedure"),
        F.size(or_empty("red_flags")).cast("long").alias("num_red_flags"),
    )


def label_codes(claims: DataFrame) -> DataFrame:
    """Sorted-value codes of location, type, provider and patient."""
    rows = claims.select(
        "claim_id",
        F.coalesce("service_location", F.lit("unknown")).alias("service_location"),
        F.coalesce("claim_type", F.lit("unknown")).alias("claim_type"),
        "provider_id",
        "patient_id",
    )
    for column, out in (
        ("service_location", "service_location_encoded"),
        ("claim_type", "claim_type_encoded"),
        ("provider_id", "provider_encoded"),
        ("patient_id", "patient_encoded"),
    ):
        rows = with_sorted_code(rows, column, out).drop(column)
    return rows


def calendar_features(claims: DataFrame) -> DataFrame:
    day = F.col("date_of_service")
    return claims.select(
        "claim_id",
        F.year(day).cast("long").alias("year"),
        F.month(day).cast("long").alias("month"),
        F.day(day).cast("long").alias("day"),
        F.weekday(day).cast("long").alias("day_of_week"),
        F.quarter(day).cast("long").alias("quarter"),
        as_flag(F.weekday(day) >= 5).alias("is_weekend"),
        as_flag(F.date_format(day, "MM-dd").isin(K.FEATURE_HOLIDAYS)).alias("is_holiday"),
        F.datediff(day, F.lit(K.EPOCH).cast("date")).cast("long").alias("days_since_epoch"),
    )


def provider_calendar(claims: DataFrame) -> DataFrame:
    """Claims of the provider on the same day and its share of weekend claims."""
    known = claims.where("provider_id IS NOT NULL").select("provider_id", "date_of_service")
    days = known.groupBy("provider_id", "date_of_service").agg(F.count(F.lit(1)).alias("n"))
    weekend = F.sum(F.when(F.weekday("date_of_service") >= 5, F.col("n")).otherwise(0))
    ratios = days.groupBy("provider_id").agg((weekend / F.sum("n")).alias("ratio"))
    return (
        claims.join(days, ["provider_id", "date_of_service"], "left")
        .join(ratios, "provider_id", "left")
        .select(
            "claim_id",
            F.coalesce("n", F.lit(0)).alias("provider_claims_same_day"),
            F.coalesce("ratio", F.lit(0.0)).alias("provider_weekend_ratio"),
        )
    )


def patient_visits(claims: DataFrame) -> DataFrame:
    """Visits and distinct providers of the claim's patient."""
    per_provider = claims.groupBy("patient_id", "provider_id").agg(F.count(F.lit(1)).alias("n"))
    stats = per_provider.groupBy("patient_id").agg(
        F.sum("n").alias("patient_total_visits"), F.count("provider_id").alias("patient_provider_diversity")
    )
    return claims.join(stats, "patient_id", "left").select(
        "claim_id", "patient_total_visits", "patient_provider_diversity"
    )


def days_since_previous(claims: DataFrame, key: str, out: str) -> DataFrame:
    """Days since the key's previous claim in (date, claim_id) order; 999 for the first.

    The dates of a key are bounded by the calendar, so the window runs over its distinct
    dates; only the first claim of a date looks back, the others follow on the same day.
    """
    days = (
        claims.where(F.col(key).isNotNull())
        .groupBy(key, "date_of_service")
        .agg(F.min("claim_id").alias("first_claim"))
    )
    earlier = F.lag("date_of_service").over(Window.partitionBy(key).orderBy("date_of_service"))
    gaps = days.withColumn("gap", F.coalesce(F.datediff("date_of_service", earlier), F.lit(NO_PREVIOUS)))
    return claims.join(gaps, [key, "date_of_service"], "left").select(
        "claim_id",
        F.when(F.col("claim_id") == F.col("first_claim"), F.col("gap"))
        .when(F.col("first_claim").isNotNull(), 0)
        .cast("long")
        .alias(out),
    )


def service_hours(claims: DataFrame) -> DataFrame:
    """Hour of service, after-hours flag and rendering hours; noon and one hour if absent."""
    has = set(claims.columns)
    hour = (
        F.hour(F.try_to_timestamp("time_of_service", F.lit("HH:mm"))) if "time_of_service" in has else F.lit(12)
    )
    late = as_flag((hour < 7) | (hour > 19))
    rendered = F.col("rendering_hours") if "rendering_hours" in has else F.lit(1.0)
    rendered_log = F.log1p("rendering_hours") if "rendering_hours" in has else F.lit(0.0)
    return claims.select(
        "claim_id",
        hour.cast("long").alias("hour_of_service"),
        late.alias("is_after_hours"),
        rendered.alias("rendering_hours"),
        rendered_log.alias("rendering_hours_log"),
    )


def referral_features(claims: DataFrame) -> DataFrame:
    """Whether the claim has a consultation code, and the provider's share of such claims."""
    flagged = claims.select(
        "claim_id", "provider_id",
        as_flag(count_in(or_empty("procedure_codes"), K.REFERRAL_CODES) > 0).alias("is_referral"),
    )
    ratios = flagged.where("provider_id IS NOT NULL").groupBy("provider_id").agg(
        F.avg("is_referral").alias("ratio")
    )
    return flagged.join(ratios, "provider_id", "left").select(
        "claim_id", "is_referral", F.coalesce("ratio", F.lit(0.0)).alias("provider_referral_ratio")
    )


def sequence_positions(claims: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Place of the claim in its patient's history and in its provider's day."""
    rows = claims.select("claim_id", "patient_id", "provider_id", "date_of_service")
    placed = with_sequence(
        rows, ["patient_id"], ["date_of_service", "claim_id"], "claim_sequence_position", limit
    )
    days = ["provider_id", "date_of_service"]
    daily = with_sequence(
        rows.where("provider_id IS NOT NULL").select("claim_id", *days),
        days, ["claim_id"], "provider_daily_sequence", limit,
    )
    return placed.join(daily.select("claim_id", "provider_daily_sequence"), "claim_id", "left").select(
        "claim_id", "claim_sequence_position", "provider_daily_sequence"
    )


def provider_switches(claims: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """How often each patient's claims change provider from one to the next."""
    rows = claims.select(
        "claim_id", "patient_id", "date_of_service", F.coalesce("provider_id", F.lit("")).alias("seen")
    )
    pairs = over_recent(
        rows, ["patient_id"], ["date_of_service", "claim_id"], 2,
        lambda frame: {"before": F.first("seen").over(frame)}, limit,
    )
    return pairs.groupBy("patient_id").agg(
        F.sum((F.col("seen") != F.col("before")).cast("long")).alias("patient_provider_switches")
    )


def amount_statistics(claims: DataFrame, key: str, prefix: str) -> DataFrame:
    """Mean, sample deviation and count of the key's amounts; 0 where undefined."""
    stats = claims.where(F.col(key).isNotNull()).groupBy(key).agg(
        (F.sum("billed_amount").cast("double") / F.count("billed_amount")).alias("mean"),
        F.stddev_samp(F.col("billed_amount").cast("double")).alias("std"),
        F.count("billed_amount").alias("n"),
    )
    return claims.join(stats, key, "left").select(
        "claim_id",
        F.col("billed_amount").cast("double").alias("amount"),
        F.coalesce("mean", F.lit(0.0)).alias(f"{prefix}_avg_amount"),
        F.coalesce("std", F.lit(0.0)).alias(f"{prefix}_std_amount"),
        F.coalesce("n", F.lit(0)).alias(f"{prefix}_claim_count"),
    )


def provider_statistics(claims: DataFrame) -> DataFrame:
    stats = amount_statistics(claims, "provider_id", "provider")
    z = (F.col("amount") - F.col("provider_avg_amount")) / (F.col("provider_std_amount") + 1e-8)
    return stats.withColumn("amount_zscore_provider", z).drop("amount")


def patient_statistics(claims: DataFrame) -> DataFrame:
    return amount_statistics(claims, "patient_id", "patient").drop("amount")


def iqr_outliers(claims: DataFrame, factor: float = 1.5) -> DataFrame:
    cuts = quantiles(claims, {"billed_amount": [0.25, 0.75]})["billed_amount"]
    spread = factor * (cuts[0.75] - cuts[0.25])
    value = F.col("billed_amount").cast("double")
    outside = (value < cuts[0.25] - spread) | (value > cuts[0.75] + spread)
    return claims.select("claim_id", as_flag(outside).alias("amount_anomaly_score"))


def percentile_ranks(claims: DataFrame) -> DataFrame:
    """Average-tie percentile rank of the amount, overall and within the specialty."""
    ranked = with_average_rank(claims, "billed_amount", "amount_percentile")
    if "provider_specialty" not in claims.columns:
        ranked = ranked.withColumn("amount_percentile_specialty", F.col("amount_percentile"))
    else:
        ranked = with_average_rank(ranked, "billed_amount", "amount_percentile_specialty", ["provider_specialty"])
    return ranked.select("claim_id", "amount_percentile", "amount_percentile_specialty")


def combine(families: list[DataFrame]) -> DataFrame:
    """Join feature families on claim_id; a column already present is not repeated."""

    def add(left: DataFrame, right: DataFrame) -> DataFrame:
        fresh = [c for c in right.columns if c == "claim_id" or c not in left.columns]
        return left.join(right.select(*fresh), "claim_id", "left")

    return reduce(add, families)


def network_features(claims: DataFrame) -> DataFrame:
    """Graph measures of the claim's provider, 0 without one, and its referrals."""
    measures = graph_features(claims.select("patient_id", "provider_id"))
    names = [c for c in measures.columns if c != "provider_id"]
    placed = claims.join(measures, "provider_id", "left").select(
        "claim_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    )
    return combine([placed, referral_features(claims)])


FAMILIES = {
    "basic": basic_features,
    "temporal": lambda claims: combine(
        [
            calendar_features(claims), provider_calendar(claims), patient_visits(claims),
            days_since_previous(claims, "patient_id", "days_since_last_visit"), service_hours(claims),
        ]
    ),
    "sequence": lambda claims: combine(
        [
            sequence_positions(claims),
            days_since_previous(claims, "patient_id", "days_between_patient_claims"),
            days_since_previous(claims, "provider_id", "days_between_provider_claims"),
        ]
    ),
    "statistical": lambda claims: combine(
        [provider_statistics(claims), patient_statistics(claims), iqr_outliers(claims), percentile_ranks(claims)]
    ),
    "network": network_features,
    "text": text_features,
}


def feature_table(claims: DataFrame, families: list[str] | None = None) -> DataFrame:
    """The chosen feature families side by side."""
    chosen = list(FAMILIES) if families is None else families
    return combine([FAMILIES[name](claims) for name in chosen])

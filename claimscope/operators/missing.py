"""Missing fields, their weight, and what submission habits they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope import constants as K
from claimscope.functions.columns import lookup
from claimscope.operators.routing import normalised_type

IMPORTANT_FIELDS = [f for f, score in K.CRITICALITY.items() if score >= K.IMPORTANT]
CHECKED_PER_CLAIM = len(K.REQUIRED_FIELDS) + len(IMPORTANT_FIELDS)
CHECKED_FOR_PATIENT = len(K.REQUIRED_FIELDS) + 5


def is_present(claims: DataFrame, field: str) -> Column:
    """Not null, not blank text, not an empty list; a column the table lacks is missing."""
    if field not in claims.columns:
        return F.lit(False)
    kind = claims.schema[field].dataType
    column = F.col(field)
    if isinstance(kind, T.StringType):
        return column.isNotNull() & (F.trim(column) != "")
    if isinstance(kind, T.ArrayType):
        return column.isNotNull() & (F.size(column) > 0)
    return column.isNotNull()


def missing_fields(claims: DataFrame) -> Column:
    """Names of the missing fields: required, required for the claim type, important."""
    kind = F.coalesce(normalised_type(), F.lit("professional"))
    absent = [F.when(~is_present(claims, f), F.lit(f)) for f in K.REQUIRED_FIELDS]
    for claim_type, fields in K.CONDITIONAL_FIELDS.items():
        absent += [F.when((kind == claim_type) & ~is_present(claims, f), F.lit(f)) for f in fields]
    for f in IMPORTANT_FIELDS:
        missing = ~is_present(claims, f)
        if f == "days_supply":
            missing = missing & (kind == "pharmacy")
        absent.append(F.when(missing, F.lit(f)))
    return F.array_distinct(F.array_compact(F.array(*absent)))


def criticality(field: Column) -> Column:
    """Weight of one missing field; required ones count 10 % more, at most 1."""
    base = lookup(field, {f: F.lit(v) for f, v in K.CRITICALITY.items()}, F.lit(K.UNKNOWN_CRITICALITY))
    raised = F.when(field.isin(K.REQUIRED_FIELDS), F.least(base * 1.1, F.lit(1.0))).otherwise(base)
    return F.round(raised, 2)


def missing_share(claims: DataFrame) -> Column:
    """Share of the important and required fields that are missing, 3 decimals."""
    fields = list(dict.fromkeys([*IMPORTANT_FIELDS, *K.REQUIRED_FIELDS]))
    count = sum((F.when(is_present(claims, f), 0).otherwise(1) for f in fields), F.lit(0))
    return F.round(count / len(fields), 3)


def with_missing(claims: DataFrame) -> DataFrame:
    return claims.withColumn("missing", missing_fields(claims))


def missing_by_field(claims: DataFrame, key: str) -> DataFrame:
    """Claims of the key that miss each field."""
    return (
        with_missing(claims)
        .select(key, F.explode("missing").alias("field"))
        .groupBy(key, "field")
        .agg(F.count(F.lit(1)).alias("claims_missing"))
    )


def provider_pattern(claims: DataFrame) -> DataFrame:
    """Missing rate, systematically missing fields and suspicion per NPI."""
    known = claims.where("provider_npi IS NOT NULL")
    sizes = known.groupBy("provider_npi").agg(F.count(F.lit(1)).alias("claim_count"))
    per_field = missing_by_field(known, "provider_npi")
    summary = (
        per_field.join(sizes, "provider_npi")
        .groupBy("provider_npi")
        .agg(
            F.sum("claims_missing").alias("total_missing"),
            F.sum((F.col("claims_missing") / F.col("claim_count") > 0.5).cast("long")).alias("systematic_fields"),
        )
    )
    rate = F.coalesce("total_missing", F.lit(0)) / (F.col("claim_count") * CHECKED_PER_CLAIM)
    systematic = F.coalesce("systematic_fields", F.lit(0))
    base = F.least(rate * 3.0, F.lit(1.0))
    score = F.when(systematic > 0, F.least(base + systematic * 0.15, F.lit(1.0))).otherwise(base)
    return sizes.join(summary, "provider_npi", "left").select(
        "provider_npi",
        "claim_count",
        F.round(rate, 3).alias("missing_rate"),
        systematic.alias("systematic_fields"),
        F.round(score, 3).alias("suspicious_score"),
    )


def patient_pattern(claims: DataFrame) -> DataFrame:
    """Missing rate and suspicion per patient."""
    rates = with_missing(claims).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        (F.sum(F.size("missing")) / (F.count(F.lit(1)) * CHECKED_FOR_PATIENT)).alias("rate"),
    )
    score = F.when(F.col("rate") > 0.20, F.least(F.col("rate") * 2.5, F.lit(1.0))).otherwise(0.0)
    return rates.select(
        "patient_id", "claim_count", F.round("rate", 3).alias("missing_rate"),
        F.round(score, 3).alias("suspicious_score"),
    )


def submission_histograms(claims: DataFrame) -> DataFrame:
    """Submissions per NPI by weekday (Monday = 0) and by hour, in long form."""
    stamp = F.col("submission_timestamp")
    parts = F.array(
        F.struct(F.lit("weekday").alias("part"), F.weekday(stamp).cast("long").alias("value")),
        F.struct(F.lit("hour").alias("part"), F.hour(stamp).cast("long").alias("value")),
    )
    return (
        claims.where(stamp.isNotNull() & F.col("provider_npi").isNotNull())
        .select("provider_npi", F.inline(parts))
        .groupBy("provider_npi", "part", "value")
        .agg(F.count(F.lit(1)).alias("claims"))
    )


def submission_timing() -> dict[str, Column]:
    """Weekend, night and anomaly flags of the submission time."""
    stamp = F.col("submission_timestamp")
    weekend = F.weekday(stamp) >= 5
    night = (F.hour(stamp) < 6) | (F.hour(stamp) > 22)
    return {
        "day_of_week": F.weekday(stamp).cast("long"),
        "hour": F.hour(stamp).cast("long"),
        "is_weekend": weekend,
        "is_night_time": night,
        "temporal_anomaly": weekend | night,
    }


def submission_suspicion(claims: DataFrame) -> DataFrame:
    """Mean of provider, patient, missing-field and timing factors, damped or raised."""
    provider = provider_pattern(claims).select("provider_npi", F.col("suspicious_score").alias("provider_score"))
    patient = patient_pattern(claims).select("patient_id", F.col("suspicious_score").alias("patient_score"))
    missing = missing_fields(claims)
    anomaly = submission_timing()["temporal_anomaly"]
    rows = claims.select(
        "claim_id", "provider_npi", "patient_id", missing.alias("missing"), anomaly.alias("anomaly")
    )
    weight = F.aggregate("missing", F.lit(0.0), lambda acc, f: acc + criticality(f)) / F.size("missing")
    factors = F.array_compact(
        F.array(
            F.col("provider_score"),
            F.col("patient_score"),
            F.when(F.size("missing") > 0, weight),
            F.when(F.col("anomaly"), F.lit(0.60)),
        )
    )
    mean = F.aggregate("factors", F.lit(0.0), lambda acc, x: acc + x) / F.size("factors")
    score = (
        F.when(F.size("factors") == 0, F.lit(0.0))
        .when(F.forall("factors", lambda x: x < 0.40), mean * 0.80)
        .when((F.size("factors") >= 3) & (mean > 0.50), F.least(mean * 1.15, F.lit(1.0)))
        .otherwise(mean)
    )
    return (
        rows.join(provider, "provider_npi", "left")
        .join(patient, "patient_id", "left")
        .select("claim_id", factors.alias("factors"))
        .select(
            "claim_id",
            F.size("factors").cast("long").alias("factor_count"),
            F.round(score, 3).alias("suspicion"),
        )
    )

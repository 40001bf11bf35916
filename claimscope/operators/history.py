"""Patient histories: documents, windows, diversity, red flags and narrative.

The claims of one patient are unbounded, so a history document comes in pages of a fixed
number of claims. All figures are aggregations and never gather a patient's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.constants import CONTROLLED_CODES
from claimscope.functions.columns import or_empty
from claimscope.functions.skew import GROUP_LIMIT, with_sequence

PAGE = 1000


def history_documents(claims: DataFrame, page: int = PAGE, limit: int = GROUP_LIMIT) -> DataFrame:
    """Date-ordered claim lists per patient, ``page`` claims per row."""
    placed = with_sequence(claims, ["patient_id"], ["date_of_service", "claim_id"], "place", limit)
    fields = [c for c in claims.columns if c != "patient_id"]
    entry = F.struct("place", *fields)
    return (
        placed.withColumn("page", F.floor((F.col("place") - 1) / page))
        .groupBy("patient_id", "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("claim_sequence"))
    )


def recent_windows(claims: DataFrame) -> DataFrame:
    """Providers and claims in the 30 and 90 days up to the patient's latest claim."""
    totals = claims.groupBy("patient_id").agg(
        F.max("date_of_service").alias("latest"),
        (F.sum("billed_amount").cast("double") / F.count("billed_amount")).alias("avg_claim_amount"),
    )
    age = F.datediff("latest", "date_of_service")
    recent = (
        claims.join(totals.select("patient_id", "latest"), "patient_id")
        .where(age <= 90)
        .groupBy("patient_id", "provider_npi")
        .agg(F.count(F.lit(1)).alias("n90"), F.sum((age <= 30).cast("long")).alias("n30"))
        .groupBy("patient_id")
        .agg(
            F.sum((F.col("provider_npi").isNotNull() & (F.col("n30") > 0)).cast("long")).alias("provider_count_30d"),
            F.count("provider_npi").alias("provider_count_90d"),
            F.sum("n30").alias("total_claims_30d"),
            F.sum("n90").alias("total_claims_90d"),
        )
    )
    return recent.join(totals.drop("latest"), "patient_id")


def diagnosis_diversity(claims: DataFrame) -> DataFrame:
    """Distinct over total diagnosis codes per patient."""
    return (
        claims.select("patient_id", F.explode("diagnosis_codes").alias("code"))
        .groupBy("patient_id", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("patient_id")
        .agg((F.count(F.lit(1)) / F.sum("n")).alias("diagnosis_diversity"))
    )


def date_ranges(claims: DataFrame) -> DataFrame:
    """First and last date and mean days between claims."""
    n = F.count(F.lit(1))
    first, last = F.min("date_of_service"), F.max("date_of_service")
    return claims.groupBy("patient_id").agg(
        n.alias("claim_count"),
        first.alias("date_range_start"),
        last.alias("date_range_end"),
        F.when(n > 1, F.datediff(last, first) / (n - 1)).otherwise(0.0).alias("claim_frequency_days"),
    )


def red_flags(limits: dict[str, int] | None = None) -> Column:
    """Red-flag texts from the pattern columns a table has."""
    limits = {
        "provider_count_30d": 5, "pharmacy_count_30d": 3, "early_refill_count": 2,
        "controlled_substance_prescriptions": 4, "geographic_impossibility_count": 1, **(limits or {}),
    }
    wording = {
        "provider_count_30d": ("Doctor shopping: ", " providers in 30 days"),
        "pharmacy_count_30d": ("Pharmacy hopping: ", " pharmacies in 30 days"),
        "early_refill_count": ("Early refills: ", " instances"),
        "controlled_substance_prescriptions": (
            "Excessive controlled substances: ", " prescriptions in 90 days",
        ),
        "geographic_impossibility_count": ("Geographic impossibilities: ", " detected"),
    }
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(name) >= limits[name],
                    F.concat(F.lit(before), F.col(name).cast("string"), F.lit(after)),
                )
                for name, (before, after) in wording.items()
            ]
        )
    )


PATTERN_COLUMNS = [
    "provider_count_30d", "pharmacy_count_30d", "early_refill_count",
    "controlled_substance_prescriptions", "geographic_impossibility_count",
]


def with_absent_patterns(patterns: DataFrame) -> DataFrame:
    """Pattern columns a source cannot give count 0."""
    absent = {c: F.lit(0).cast("long") for c in PATTERN_COLUMNS if c not in patterns.columns}
    return patterns.withColumns(absent)


def prescription_patterns(claims: DataFrame) -> DataFrame:
    """Controlled-substance codes over the patient's latest 90 days."""
    latest = claims.groupBy("patient_id").agg(F.max("date_of_service").alias("latest"))
    age = F.datediff("latest", "date_of_service")
    controlled = F.size(F.filter(or_empty("procedure_codes"), lambda c: c.isin(CONTROLLED_CODES)))
    return (
        claims.join(latest, "patient_id")
        .where(age <= 90)
        .groupBy("patient_id")
        .agg(F.sum(controlled).alias("controlled_substance_prescriptions"))
    )


def top_codes(claims: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The patient's ``k`` most frequent codes; equal counts in code order."""
    counts = (
        claims.select("patient_id", F.explode(column).alias("code"))
        .groupBy("patient_id", "code")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = Window.partitionBy("patient_id").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return ranked.groupBy("patient_id").agg(
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda e: e["code"])
        ).alias("codes")
    )


def narratives(claims: DataFrame) -> DataFrame:
    """One sentence group per patient describing the history."""
    windows = with_absent_patterns(recent_windows(claims))
    dx = top_codes(claims, "diagnosis_codes").withColumnRenamed("codes", "top_dx")
    px = top_codes(claims, "procedure_codes").withColumnRenamed("codes", "top_px")
    rows = (
        date_ranges(claims)
        .join(windows, "patient_id")
        .join(dx, "patient_id", "left")
        .join(px, "patient_id", "left")
        .withColumn("flags", red_flags())
    )
    providers = F.col("provider_count_90d")
    mean = F.round(F.col("avg_claim_amount").cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("Patient has "), "claim_count", F.lit(" claims")),
            F.when(providers != 1, F.concat(F.lit("across "), providers, F.lit(" providers"))).otherwise("with 1 provider"),
            F.concat(F.lit("over "), F.datediff("date_range_end", "date_range_start"), F.lit(" days")),
            F.when(F.col("top_dx") != "", F.concat(F.lit("Primary diagnoses: "), "top_dx")),
            F.when(F.col("top_px") != "", F.concat(F.lit("Common procedures: "), "top_px")),
            F.concat(F.lit("Average claim amount $"), mean.cast("string")),
            F.when(F.size("flags") > 0, F.concat(F.lit("Red flags: "), F.concat_ws("; ", "flags"))).otherwise(
                "No red flags detected"
            ),
        )
    )
    return rows.select("patient_id", F.concat(F.concat_ws(". ", parts), F.lit(".")).alias("narrative"))

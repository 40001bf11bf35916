"""Marts, rank fusion, configurable rules, drift and risk cards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope import constants as K
from claimscope.functions.skew import GROUP_LIMIT, over_recent, running_total, with_average_rank


def fuse_ranks(lists: list[DataFrame], by: str, item: str, k: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists of (by, item, rank)."""
    together = lists[0].select(by, item, "rank")
    for ranked in lists[1:]:
        together = together.unionByName(ranked.select(by, item, "rank"))
    return together.groupBy(by, item).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))


def first_of_equal(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Of rows with equal text the first in ``order``; copies combine map-side."""
    digest = F.sha2(F.col(text), 256)
    return rows.groupBy(digest.alias("digest")).agg(F.min(order).alias(order)).select(order)


def fraud_mart(facts: DataFrame) -> DataFrame:
    """Claims, amounts and fraud by year, month, specialty and age group."""
    fraud = F.col("fraud_indicator")
    return facts.groupBy(
        F.year("date_of_service").alias("year"), F.month("date_of_service").alias("month"),
        F.col("provider_specialty").alias("specialty"), "age_group",
    ).agg(
        F.count_distinct("claim_id").alias("claim_count"),
        F.sum("billed_amount").alias("total_amount"),
        F.count(F.when(fraud, 1)).alias("fraud_count"),
        F.coalesce(F.sum(F.when(fraud, F.col("billed_amount"))), F.lit(0)).alias("fraud_amount"),
    )


def date_dimension(dates: DataFrame, column: str) -> DataFrame:
    """One row per day between the first and last date of a table."""
    day = F.col("full_date")
    days = dates.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("full_date")
    )
    return days.select(
        F.date_format(day, "yyyyMMdd").cast("int").alias("date_key"),
        day,
        F.year(day).alias("year"),
        F.quarter(day).alias("quarter"),
        F.month(day).alias("month"),
        F.weekofyear(day).alias("week"),
        F.weekday(day).alias("day_of_week"),
        (F.weekday(day) >= 5).alias("is_weekend"),
        F.date_format(day, "MM-dd").isin(K.FEATURE_HOLIDAYS).alias("is_holiday"),
    )


def patient_year(claims: DataFrame, as_of: str) -> DataFrame:
    """Providers and procedures of each patient in the 12 months before ``as_of``.

    In long form, so that neither the provider set nor the frequency table of a patient
    has to fit into one row.
    """
    recent = claims.where(
        (F.col("date_of_service") >= F.add_months(F.lit(as_of).cast("date"), -12))
        & (F.col("date_of_service") <= F.lit(as_of).cast("date"))
    )
    entries = F.concat(
        F.array(F.struct(F.lit("claims").alias("kind"), F.lit("").alias("value"))),
        F.array(F.struct(F.lit("provider").alias("kind"), F.col("provider_npi").alias("value"))),
        F.transform(
            F.coalesce("procedure_codes", F.array().cast("array<string>")),
            lambda c: F.struct(F.lit("procedure").alias("kind"), c.alias("value")),
        ),
    )
    return (
        recent.select("patient_id", F.inline(entries))
        .where("value IS NOT NULL")
        .groupBy("patient_id", "kind", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- configurable rules -----------------------------------------------------------------

OPERATORS: dict[str, Callable[[Column, object], Column]] = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "regex": lambda c, v: c.rlike(v),
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
}


@dataclass(frozen=True)
class Pattern:
    """Conditions of (field, operator, value, weight) and how they add up."""

    name: str
    conditions: tuple[tuple[str, str, object, float], ...]
    aggregation: str = "weighted_sum"
    threshold: float = 0.5


def pattern_score(pattern: Pattern) -> Column:
    """Share or weight of the conditions met; a condition on a missing value is not met."""
    met = [
        F.coalesce(OPERATORS[op](F.col(name), value), F.lit(False)).cast("double")
        for name, op, value, _ in pattern.conditions
    ]
    if pattern.aggregation == "weighted_sum":
        return sum((m * w for m, (*_, w) in zip(met, pattern.conditions)), F.lit(0.0))
    return sum(met, F.lit(0.0)) / len(met)


def pattern_matches(claims: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Claims matching each configured pattern, with the score."""
    results = []
    for p in patterns:
        score = pattern_score(p)
        matched = {
            "all": score >= 1.0, "any": score > 0.0, "majority": score > 0.5,
            "weighted_sum": score >= p.threshold,
        }[p.aggregation]
        results.append(
            F.when(matched, F.struct(F.lit(p.name).alias("pattern"), score.alias("score")))
        )
    return claims.select("claim_id", F.inline(F.array_compact(F.array(*results))))


# --- drift ---------------------------------------------------------------------------------


def ks_statistic(rows: DataFrame, value: str, current: str) -> DataFrame:
    """Largest distance between the distributions of two samples, with its p-value.

    ``current`` tells the samples apart. Counts per distinct value are cumulated chunk by
    chunk.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.count(F.when(~F.col(current), 1)).alias("a"), F.count(F.when(F.col(current), 1)).alias("b")
    )
    summed = running_total(running_total(counts, [], [value], "a", "upto_a"), [], [value], "b", "upto_b")
    totals = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n, m = float(totals["a"]), float(totals["b"])
    gap = F.max(F.abs(F.col("upto_a") / n - F.col("upto_b") / m))
    size = n * m / (n + m)
    factor = size**0.5 + 0.12 + 0.11 / size**0.5
    scaled = F.col("statistic") * factor
    terms = [(2 if j % 2 else -2) * F.exp(-2 * j * j * scaled * scaled) for j in range(1, 21)]
    p = F.when(scaled < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(terms, F.lit(0.0)))))
    return summed.agg(gap.alias("statistic")).withColumn("p_value", p).withColumn("is_drift", F.col("p_value") < 0.05)


def chi_square(rows: DataFrame, category: str, current: str) -> DataFrame:
    """Chi-square statistic of a category against the two samples, and its freedom."""
    counts = rows.where(F.col(category).isNotNull()).groupBy(category).agg(
        F.count(F.when(~F.col(current), 1)).alias("a"), F.count(F.when(F.col(current), 1)).alias("b")
    )
    totals = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    n, m = float(totals["a"]), float(totals["b"])
    both = F.col("a") + F.col("b")

    def term(part: str, share: float) -> Column:
        expected = both * share
        return (F.col(part) - expected) * (F.col(part) - expected) / expected

    return counts.agg(
        F.sum(term("a", n / (n + m)) + term("b", m / (n + m))).alias("statistic"),
        (F.count(F.lit(1)) - 1).alias("freedom"),
    )


# --- cards and refills -----------------------------------------------------------------------


def provider_risk_cards(claims: DataFrame) -> DataFrame:
    """Daily claims, mean amount, and standing within the specialty per provider."""
    known = claims.where("provider_id IS NOT NULL")
    days = known.groupBy("provider_id", "provider_specialty", "date_of_service").agg(
        F.count(F.lit(1)).alias("n"), F.sum("billed_amount").alias("amount")
    )
    cards = days.groupBy("provider_id", "provider_specialty").agg(
        F.avg("n").alias("avg_daily_claims"),
        (F.sum("amount").cast("double") / F.sum("n")).alias("avg_claim_amount"),
    )
    peers = cards.groupBy("provider_specialty").agg(
        F.avg("avg_claim_amount").alias("specialty_avg"), F.stddev_samp("avg_claim_amount").alias("specialty_std")
    )
    ranked = with_average_rank(cards, "avg_claim_amount", "percentile_rank", ["provider_specialty"])
    return ranked.join(peers, "provider_specialty").select(
        "provider_id", "provider_specialty", "avg_daily_claims", "avg_claim_amount", "specialty_avg",
        "percentile_rank",
        F.when(
            F.col("specialty_std") > 0, (F.col("avg_claim_amount") - F.col("specialty_avg")) / F.col("specialty_std")
        ).otherwise(0.0).alias("standard_deviations"),
    )


def early_refills(fills: DataFrame, days_early: int = 5, limit: int = GROUP_LIMIT) -> DataFrame:
    """Fills at least ``days_early`` days before the supply of the patient's last fill ends."""
    paired = over_recent(
        fills, ["patient_id"], ["fill_date", "claim_id"], 2,
        lambda frame: {
            "before": F.first(F.struct("fill_date", "days_supply")).over(frame),
            "frame_rows": F.count(F.lit(1)).over(frame),
        },
        limit,
    )
    early = F.datediff(F.date_add("before.fill_date", F.col("before.days_supply").cast("int")), "fill_date")
    return paired.where((F.col("frame_rows") > 1) & (early >= days_early)).select(
        "claim_id", "patient_id", early.cast("long").alias("days_early")
    )


def crowded_prescribers(claims: DataFrame, key: str, days: int = 30, more_than: int = 3, out: str = "prescribers") -> DataFrame:
    """Claims whose patient saw more than ``more_than`` values of ``key`` in the last ``days`` days.

    A visit counts for its own day and ``days`` more; visits of one patient to one key whose
    spans meet make one span, which adds one at its start and takes it away after its end. The
    running sum of these steps is the number of keys. Steps are summed per patient and day
    first, so the calendar bounds the rows of a patient, and those of a patient and key.
    Claims without patient or date have no result; a null key is nobody.
    """
    seen = claims.where("patient_id IS NOT NULL AND date_of_service IS NOT NULL").select(
        "patient_id", F.col("date_of_service").alias("day"), F.col(key).alias("who")
    )
    visits = seen.where("who IS NOT NULL").groupBy("patient_id", "who").agg(F.sort_array(F.collect_set("day")).alias("at"))

    def apart(day: Column, other: Column) -> Column:
        return other.isNull() | (F.abs(F.datediff(day, other)) > days + 1)

    starts = F.filter("at", lambda day, i: apart(day, F.get("at", i - 1)))
    ends = F.filter("at", lambda day, i: apart(day, F.get("at", i + 1)))
    steps = F.concat(
        F.transform(starts, lambda day: F.struct(day.alias("day"), F.lit(1).alias("step"))),
        F.transform(ends, lambda day: F.struct(F.date_add(day, days + 1).alias("day"), F.lit(-1).alias("step"))),
    )
    asked = seen.select("patient_id", "day", F.lit(0).alias("step"), F.lit(True).alias("asked"))
    changes = visits.select("patient_id", F.inline(steps)).withColumn("asked", F.lit(False))
    by_day = changes.unionByName(asked).groupBy("patient_id", "day").agg(F.sum("step").alias("step"), F.max("asked").alias("asked"))
    so_far = Window.partitionBy("patient_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counts = (
        by_day.withColumn(out, F.sum("step").over(so_far))
        .where(F.col("asked") & (F.col(out) > more_than))
        .select("patient_id", F.col("day").alias("date_of_service"), out)
    )
    return claims.join(counts, ["patient_id", "date_of_service"]).select("claim_id", out)

"""Preprocessing features and transforms fitted on one table and applied to others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import as_flag, or_empty
from claimscope.functions.skew import quantiles, running_total
from claimscope.session import materialise


def amount() -> Column:
    return F.col("billed_amount").cast("double")


def amount_features() -> dict[str, Column]:
    """log1p, round-hundred flag and right-closed bin of the amount."""
    value = amount()
    return {
        "amount_log": F.log1p(value),
        "amount_rounded": as_flag(F.col("billed_amount") % 100 == 0),
        "amount_bin": F.when(value <= 0, None)
        .when(value <= 100, "low")
        .when(value <= 500, "medium")
        .when(value <= 1000, "high")
        .when(value <= 5000, "very_high")
        .when(value > 5000, "extreme"),
    }


def id_features() -> dict[str, Column]:
    second = lambda c: F.try_element_at(F.split(c, "-"), F.lit(2))
    return {
        "provider_prefix": second("provider_id"),
        "patient_prefix": second("patient_id"),
        "npi_last_digit": F.right("provider_npi", F.lit(1)).try_cast("bigint"),
    }


def date_features(column: str) -> dict[str, Column]:
    """Calendar parts of one date column, Monday = 0."""
    day = F.col(column)
    return {
        f"{column}_year": F.year(day).cast("long"),
        f"{column}_month": F.month(day).cast("long"),
        f"{column}_day": F.day(day).cast("long"),
        f"{column}_weekday": F.weekday(day).cast("long"),
        f"{column}_is_weekend": as_flag(F.weekday(day) >= 5),
        f"{column}_quarter": F.quarter(day).cast("long"),
        f"{column}_days_since_epoch": F.datediff(day, F.lit(K.EPOCH).cast("date")).cast("long"),
    }


def days_to_service() -> Column:
    return F.datediff("date_of_service", "accident_date").cast("long")


def shape_flags() -> dict[str, Column]:
    """Counts of codes, place of service and supply as flags."""
    dx, px = F.size(or_empty("diagnosis_codes")), F.size(or_empty("procedure_codes"))
    return {
        "multiple_diagnoses": as_flag(dx > 1),
        "many_procedures": as_flag(px > 5),
        "procedure_to_diagnosis_ratio": px / (dx + 1),
        "emergency_service": as_flag(F.col("service_location") == "23"),
        "office_service": as_flag(F.col("service_location") == "11"),
        "long_supply": as_flag(F.col("days_supply") > 30),
        "excessive_supply": as_flag(F.col("days_supply") > 90),
        "high_quantity": as_flag(F.col("quantity") > 100),
    }


def provider_profile(claims: DataFrame) -> DataFrame:
    """Claims with the figures of their NPI joined back.

    Aggregating before the join keeps a hot NPI at one row on the build side; the probe
    side of a hot NPI is split by the adaptive skew join.
    """
    stats = claims.where("provider_npi IS NOT NULL").groupBy("provider_npi").agg(
        F.count(F.lit(1)).alias("provider_claim_count"),
        (F.sum("billed_amount").cast("double") / F.count("billed_amount")).alias("provider_avg_amount"),
        F.stddev_samp(amount()).alias("provider_amount_std"),
        F.sum("billed_amount").cast("double").alias("provider_total_amount"),
        F.avg(F.col("fraud_indicator").cast("double")).alias("provider_fraud_rate"),
    )
    top = stats.agg(
        F.max("provider_avg_amount").alias("avg"), F.max("provider_claim_count").alias("count")
    ).first()
    risk = (
        F.col("provider_fraud_rate") * 0.4
        + F.col("provider_avg_amount") / F.lit(top["avg"]) * 0.3
        + F.col("provider_claim_count") / F.lit(top["count"]) * 0.3
    )
    return claims.join(stats, "provider_npi", "left").withColumns(
        {
            "provider_risk_score": risk,
            "provider_suspicious_npi": as_flag(F.col("provider_npi").startswith("9999999")),
            "provider_test_id": as_flag(F.col("provider_id").rlike("FRAUD|TEST")),
        }
    )


def amount_position(claims: DataFrame) -> DataFrame:
    """Percentile flags, global z-score and outlier flag of the amount."""
    cuts = quantiles(claims, {"billed_amount": [0.25, 0.9, 0.95]})["billed_amount"]
    stats = claims.agg(F.avg(amount()).alias("mean"), F.stddev_samp(amount()).alias("std")).first()
    z = (amount() - stats["mean"]) / F.lit(stats["std"])
    return claims.withColumns(
        {
            "amount_below_25th": as_flag(amount() <= cuts[0.25]),
            "amount_above_90th": as_flag(amount() >= cuts[0.9]),
            "amount_above_95th": as_flag(amount() >= cuts[0.95]),
            "amount_zscore": z,
            "amount_outlier": as_flag(F.abs(z) > 3),
        }
    )


def value_places(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, place, n): the distinct values of each column, numbered from 0 in order, and their rows.

    Nulls are no values. The table is written out, as places must not change between uses.
    """
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.inline(each)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts.withColumn("_one", F.lit(1)), ["feature"], ["value"], "_one", "place")
    return materialise(placed.select("feature", "value", (F.col("place") - 1).alias("place"), "n"))


def with_place(rows: DataFrame, places: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the place of the value of ``column``; null for an unknown value and for null."""
    own = places.where(F.col("feature") == column).select(F.col("value").alias("_value"), F.col("place").alias(out))
    return rows.join(own, rows[column].cast("string") == own["_value"], "left").drop("_value")


def one_hot_entries(rows: DataFrame, key: str, places: DataFrame, columns: list[str]) -> DataFrame:
    """One-hot coding in long form: (key, feature, place) for each entry that is 1.

    The first value of a feature has no entry, as in ``one_hot``; nor have unknown values and nulls.
    """
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    hot = places.where("place > 0").select("feature", "value", "place")
    return rows.select(key, F.inline(each)).join(hot, ["feature", "value"]).select(key, "feature", "place")


@dataclass
class Preprocessor:
    """Imputation, encoding and scaling fitted on one table.

    The values of categorical columns are kept as a table (``places``) of any size. Columns of
    at most ``wide_categories`` values are encoded by expressions; others by a join with it.
    """

    numeric: list[str]
    categorical: list[str]
    wide_categories: int = 1000
    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)
    places: DataFrame | None = None

    def fit(self, rows: DataFrame) -> Preprocessor:
        if self.numeric:
            cuts = quantiles(rows, {c: [0.5] for c in self.numeric})
            self.medians = {c: cuts[c][0.5] for c in self.numeric}
        if self.categorical:
            self.places = value_places(rows, self.categorical)
            mode = F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
            found = {r["feature"]: r for r in self.places.groupBy("feature").agg(F.count(F.lit(1)).alias("size"), mode).collect()}
            self.modes = {c: found[c]["mode"] if c in found else None for c in self.categorical}
            self.sizes = {c: found[c]["size"] if c in found else 0 for c in self.categorical}
            few = [c for c in self.categorical if self.sizes[c] <= self.wide_categories]
            listed = self.places.where(F.col("feature").isin(few)).orderBy("feature", "place").collect()
            self.categories = {c: [r["value"] for r in listed if r["feature"] == c] for c in few}
        if self.numeric:
            full = self.impute(rows)
            stats = full.agg(
                *[f(F.col(c)).alias(f"{c}_{n}") for c in self.numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]
            ).first()
            self.scales = {c: (stats[f"{c}_m"], stats[f"{c}_s"]) for c in self.numeric}
        return self

    def impute(self, rows: DataFrame) -> DataFrame:
        """Missing numbers become the median, missing categories the most frequent value."""
        numbers = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        names = {c: F.coalesce(F.col(c), F.lit(self.modes[c])) for c in self.categorical}
        return rows.withColumns({**numbers, **names})

    def _joined(self) -> list[str]:
        """Columns with more values than are held in expressions."""
        return [c for c in self.categorical if c not in self.categories]

    def one_hot(self, rows: DataFrame) -> DataFrame:
        """0/1 columns for all but the first sorted category; unknown values are all zero.

        A column of more than ``wide_categories`` values becomes ``{column}_hot``, the place of
        its only 1 among ``sizes[column] - 1`` entries counted from 0, or null where all are zero.
        """
        columns = {
            f"{c}_{value}": as_flag(F.col(c) == value)
            for c, values in self.categories.items()
            for value in values[1:]
        }
        rows = rows.withColumns(columns)
        for c in self._joined():
            rows = with_place(rows, self.places.where("place > 0").withColumn("place", F.col("place") - 1), c, f"{c}_hot")
        return rows

    def label_encode(self, rows: DataFrame) -> DataFrame:
        """Place of the value among the sorted categories; unknown values become null."""
        def code(c: str) -> Column:
            place = F.array_position(F.array(*[F.lit(v) for v in self.categories[c]]), F.col(c))
            return F.when(place > 0, place - 1)

        rows = rows.withColumns({f"{c}_code": code(c) if self.sizes[c] else F.lit(None).cast("long") for c in self.categories})
        for c in self._joined():
            rows = with_place(rows, self.places, c, f"{c}_code")
        return rows

    def scale(self, rows: DataFrame) -> DataFrame:
        """Zero mean and unit population deviation; constant columns become 0."""
        scaled = {}
        for c in self.numeric:
            mean, deviation = self.scales[c]
            scaled[f"{c}_scaled"] = (F.col(c) - mean) / (deviation or 1.0)
        return rows.withColumns(scaled)

    def transform(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Fitted imputation, one-hot and scaling on other rows.

        Columns the rows lack are added as 0, others than ``keep`` and the fitted ones are
        dropped, and the order is that of the fit.
        """
        for c in self.numeric:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(0.0))
        for c in self.categorical:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        encoded = self.scale(self.one_hot(self.impute(rows)))
        hot = [f"{c}_{v}" for c, values in self.categories.items() for v in values[1:]] + [f"{c}_hot" for c in self._joined()]
        return encoded.select(*keep, *[f"{c}_scaled" for c in self.numeric], *hot)


def feature_profile(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Per feature: |correlation| with the label, mean, std, min, max and share missing."""
    target = F.col(label).cast("double")
    measures = {
        "correlation": lambda x: F.coalesce(F.abs(F.corr(x, target)), F.lit(0.0)),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "missing_pct": lambda x: F.avg(x.isNull().cast("double")) * 100,
    }
    wide = rows.agg(
        *[
            measure(F.col(f).cast("double")).alias(f"{f}__{name}")
            for f in features
            for name, measure in measures.items()
        ]
    )
    stacked = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{name}").alias(name) for name in measures])
            for f in features
        ]
    )
    return wide.select(F.inline(stacked))


def label_correlation(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """|correlation| of every feature with the label; undefined ones count 0."""
    return feature_profile(rows, features, label).select("feature", F.col("correlation").alias("importance"))


def top_features(importances: DataFrame, k: int) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)

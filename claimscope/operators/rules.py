"""Nine scored billing rules.

Points are whole hundredths, so sums and thresholds compare exactly. Rules that look at
one claim are Columns of a single projection; rules that look at other claims first
reduce those claims to one value per claim, provider or code.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope import constants as K
from claimscope.functions.columns import empty_texts, lookup, or_empty, texts
from claimscope.functions.skew import GROUP_LIMIT, over_recent, with_sequence

RULE_COLUMNS = [
    "claim_id", "patient_id", "provider_id", "date_of_service", "day_of_week", "time_of_service",
    "service_location", "claim_type", "billed_amount", "procedure_codes", "diagnosis_codes",
    "red_flags", "referred_to_provider",
]


@dataclass
class RuleConfig:
    """Weight, threshold and switch per rule, and the numeric limits."""

    rules: dict[str, dict] = field(
        default_factory=lambda: {
            name: {"fraud_type": kind, "weight": weight, "threshold": threshold, "enabled": True}
            for name, (kind, weight, threshold) in K.RULES.items()
        }
    )
    thresholds: dict = field(default_factory=lambda: copy.deepcopy(K.THRESHOLDS))

    def override(self, settings: dict) -> RuleConfig:
        """Take over the settings of known rules, and any thresholds."""
        result = copy.deepcopy(self)
        for name, values in settings.get("rules", {}).items():
            if name in result.rules:
                known = {k: v for k, v in values.items() if k in ("weight", "threshold", "enabled")}
                result.rules[name].update(known)
        result.thresholds.update(settings.get("thresholds", {}))
        return result

    @classmethod
    def load(cls, path: str) -> RuleConfig:
        with open(path) as file:
            return cls().override(json.load(file))

    def enabled(self) -> list[str]:
        return [name for name, rule in self.rules.items() if rule["enabled"]]


def points(value: float) -> int:
    return round(value * 100)


# --- values drawn from other claims ----------------------------------------------


DAY = ["patient_id", "provider_id", "date_of_service"]
MAX_LISTS = 200


def same_day_overlaps(claims: DataFrame, max_lists: int = MAX_LISTS) -> DataFrame:
    """Other claims of the same patient, provider and day that share a procedure code.

    Claims with equal code lists are counted together, so copies cost one row. Days of at
    most ``max_lists`` different lists compare those lists with each other; on fuller days
    the claims having a code are held as bitmaps, and a list joins the bitmaps of its codes.
    """
    rows = claims.where("provider_id IS NOT NULL AND size(procedure_codes) > 0").select(
        "claim_id", *DAY, F.array_sort(F.array_distinct("procedure_codes")).alias("codes")
    )
    lists = rows.groupBy(*DAY, "codes").agg(F.count(F.lit(1)).alias("n"))
    days = lists.groupBy(*DAY).agg(F.sum("n").alias("claims"), F.count(F.lit(1)).alias("lists"))
    shared = days.where("claims > 1")
    few = lists.join(shared.where(F.col("lists") <= max_lists).select(*DAY), DAY, "left_semi")
    found = _overlaps_of_few(few)
    if (days.agg(F.max("lists")).first()[0] or 0) > max_lists:
        full = shared.where(F.col("lists") > max_lists).select(*DAY)
        found = found.unionByName(_overlaps_of_many(rows.join(full, DAY, "left_semi")))
    return found.where("overlaps > 0")


def _overlaps_of_few(lists: DataFrame) -> DataFrame:
    """Lists compared pairwise; each pair counts once, at its smallest shared code."""
    left = lists.select(*DAY, "codes", F.explode("codes").alias("code"))
    right = lists.select(
        *DAY, F.col("codes").alias("other_codes"), F.col("n").alias("others"), F.explode("codes").alias("code")
    )
    smallest = F.array_min(F.array_intersect("codes", "other_codes")) == F.col("code")
    return (
        left.join(right, [*DAY, "code"])
        .where(smallest)
        .groupBy(*DAY, "codes")
        .agg((F.sum("others") - 1).alias("overlaps"))
    )


def _overlaps_of_many(rows: DataFrame) -> DataFrame:
    """Bitmaps of the day's claims per code, joined per list and counted."""
    placed = with_sequence(rows, DAY, ["claim_id"], "place").select("*", F.explode("codes").alias("code"))
    by_code = placed.groupBy(*DAY, "code", F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    lists = rows.select(*DAY, "codes").distinct().select("*", F.explode("codes").alias("code"))
    reached = (
        lists.join(by_code, [*DAY, "code"])
        .groupBy(*DAY, "codes", "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("claims"))
    )
    return reached.groupBy(*DAY, "codes").agg((F.sum("claims") - 1).alias("overlaps"))


def similar_accidents(claims: DataFrame, more_than: int = 3) -> DataFrame:
    """Claims sharing a diagnosis with more than ``more_than`` auto claims.

    A code of more auto claims than that decides by itself, and only the claims of rarer
    codes, at most ``more_than`` per code, are listed and counted together.
    """
    coded = claims.select("claim_id", "claim_type", F.explode("diagnosis_codes").alias("code"))
    autos = coded.where("claim_type = 'auto'").select("code", "claim_id")
    counts = autos.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") > more_than).select("code", F.lit(None).cast("string").alias("auto_claim"))
    rare = autos.join(counts.where(F.col("n") <= more_than).select("code"), "code", "left_semi").select(
        "code", F.col("claim_id").alias("auto_claim")
    )
    met = coded.select("claim_id", "code").join(common.unionByName(rare), "code")
    enough = F.bool_or(F.col("auto_claim").isNull()) | (F.count_distinct("auto_claim") > more_than)
    return met.groupBy("claim_id").agg(enough.alias("many_similar")).where("many_similar")


def doctor_shopping(
    claims: DataFrame,
    lookback: int = K.SHOPPING_LOOKBACK,
    more_than: int = K.SHOPPING_PROVIDERS,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Distinct providers over the patient's last claims; a missing provider counts as one."""
    rows = claims.select(
        "claim_id", "patient_id", "date_of_service",
        F.coalesce("provider_id", F.lit("")).alias("seen_provider"),
    )
    counted = over_recent(
        rows, ["patient_id"], ["date_of_service", "claim_id"], lookback,
        lambda frame: {"recent_providers": F.size(F.collect_set("seen_provider").over(frame)).cast("long")},
        limit,
    )
    return counted.select(
        "claim_id", "recent_providers", (F.col("recent_providers") > more_than).alias("shopping")
    )


def referral_concentration(claims: DataFrame) -> DataFrame:
    """Largest share of one target among a provider's referrals from claims with a 99 code."""
    pairs = (
        claims.where("provider_id IS NOT NULL AND referred_to_provider IS NOT NULL")
        .where(F.exists(or_empty("procedure_codes"), lambda c: c.contains("99")))
        .groupBy("provider_id", "referred_to_provider")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return pairs.groupBy("provider_id").agg(
        F.sum("n").alias("referrals"), (F.max("n") / F.sum("n")).alias("concentration")
    )


def circular_referrals(claims: DataFrame) -> DataFrame:
    """Providers that refer to a provider which refers back to them."""
    source, target = F.col("provider_id"), F.col("referred_to_provider")
    ends = (
        claims.where("provider_id IS NOT NULL AND referred_to_provider IS NOT NULL")
        .groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"))
        .agg(F.bool_or(source <= target).alias("forth"), F.bool_or(source >= target).alias("back"))
        .where("forth AND back")
    )
    return ends.select(F.explode(F.array("a", "b")).alias("provider_id")).distinct()


def crowded_positions(
    claims: DataFrame, key: str, more_than: int, history: int, out: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """How many claims of ``key`` fell on the claim's date up to and including it.

    Counted inside the last ``history`` claims. Days that cannot pass the limit are
    dropped by a count before anything is sorted.
    """
    days = [key, "date_of_service"]
    rows = claims.where(F.col(key).isNotNull()).select("claim_id", *days)
    crowded = rows.groupBy(*days).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than).drop("n")
    placed = with_sequence(rows.join(crowded, days, "left_semi"), days, ["claim_id"], "place", limit)
    return placed.select("claim_id", F.least("place", F.lit(history)).alias(out)).where(
        F.col(out) > more_than
    )


def with_context(claims: DataFrame, config: RuleConfig, names: list[str]) -> DataFrame:
    """Add the values the named rules need from other claims."""
    limits = config.thresholds
    rows = claims
    if "unbundling_detection" in names:
        found = same_day_overlaps(claims).withColumnRenamed("codes", "sorted_codes")
        rows = rows.withColumn("sorted_codes", F.array_sort(F.array_distinct("procedure_codes")))
        rows = rows.join(found, [*DAY, "sorted_codes"], "left").drop("sorted_codes")
    if "staged_accident_pattern" in names:
        rows = rows.join(similar_accidents(claims), "claim_id", "left")
    if "prescription_fraud_volume" in names:
        rows = rows.join(doctor_shopping(claims).drop("recent_providers"), "claim_id", "left")
    if "kickback_referral_pattern" in names:
        share = referral_concentration(claims).select("provider_id", "concentration")
        circles = circular_referrals(claims).withColumn("circular", F.lit(True))
        rows = rows.join(share.join(circles, "provider_id", "full"), "provider_id", "left")
    if "billing_frequency_anomaly" in names:
        by_provider = crowded_positions(
            claims, "provider_id", limits["max_daily_claims_per_provider"], K.PROVIDER_HISTORY, "provider_today"
        )
        by_patient = crowded_positions(
            claims, "patient_id", limits["max_patient_visits_per_day"], K.PATIENT_HISTORY, "patient_today"
        )
        rows = rows.join(by_provider, "claim_id", "left").join(by_patient, "claim_id", "left")
    return rows


# --- the rules -------------------------------------------------------------------


@dataclass
class Part:
    """Points of one condition of a rule and, apart from them, the evidence it gives."""

    points: Column
    evidence: Column


def _item(condition: Column, worth: int, text: Column) -> Part:
    """One piece of evidence, or none where the condition is false or unknown."""
    return Part(F.when(condition, worth), F.when(condition, F.array(text)))


def _items(found: Column, worth: int, text) -> Part:
    """One piece of evidence per element of a list."""
    return Part(F.size(found) * worth, F.transform(found, text))


def _where(condition: Column, part: Part) -> Part:
    return Part(F.when(condition, part.points), F.when(condition, part.evidence))


def _flagged(words: list[str], worth: int, text) -> Part:
    """One piece of evidence per red flag with any of the words; most claims have no flag."""

    def mentions(flag: Column) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | F.lower(flag).contains(word)
        return found

    return _where(F.size("red_flags") > 0, _items(F.filter("red_flags", mentions), worth, text))


def _number(column: Column) -> Column:
    return column.cast("string")


def is_progression(codes: Column) -> Column:
    """At least two codes whose digits form a run of consecutive numbers."""
    digits = F.transform(codes, lambda c: F.regexp_replace(c, r"\D", "").try_cast("bigint"))
    numbers = F.array_compact(digits)
    n = F.size(numbers)
    run = (F.size(F.array_distinct(numbers)) == n) & (F.array_max(numbers) - F.array_min(numbers) == n - 1)
    return F.when(F.size(codes) < 2, False).otherwise((n >= 2) & run)


def expected_amount(codes: Column) -> Column:
    """Sum of the fee schedule over the codes, the default fee for others."""
    return F.aggregate(
        codes, F.lit(0).cast("long"),
        lambda total, code: total + lookup(code, K.FEE_SCHEDULE, K.DEFAULT_FEE).cast("long"),
    )


def _upcoding(limits: dict) -> list[Part]:
    px, dx, amount = F.col("px"), F.col("dx"), F.col("billed_amount")
    # every occurrence counts, so no array_intersect
    complex_px = F.filter(px, lambda c: c.isin(K.HIGH_COMPLEXITY_PROCEDURES))
    simple_dx = F.filter(dx, lambda c: c.isin(K.SIMPLE_DIAGNOSES))

    def found(p: Column) -> Column:
        return F.transform(
            simple_dx, lambda d: F.concat(F.lit("High complexity procedure "), p, F.lit(" for simple diagnosis "), d)
        )

    both = Part(F.size(complex_px) * F.size(simple_dx) * 30, F.flatten(F.transform(complex_px, found)))

    most = F.size(px) * (K.AVERAGE_PROCEDURE_COST * limits["suspicious_amount_multiplier"])
    return [
        _where(F.arrays_overlap(dx, texts(K.SIMPLE_DIAGNOSES)), both),
        _item(
            amount > most, 40,
            F.concat(F.lit("Billed amount $"), _number(amount), F.lit(" excessive for procedures")),
        ),
        _item(F.col("progression"), 30, F.lit("Suspicious procedure code progression detected")),
    ]


def _schedule(limits: dict) -> list[Part]:
    day, weekday = F.col("date_of_service"), F.col("day_of_week")
    hours = limits["phantom_billing_hours"]
    clock = F.col("time_of_service")
    hour = F.split(clock, ":")[0].try_cast("int")
    known = day.isNotNull()
    weekend = weekday.isin("Saturday", "Sunday") & (F.coalesce("service_location", F.lit("")) != "23")
    return [
        _item(
            known & weekend, 40,
            F.concat(F.lit("Service on "), weekday, F.lit(" for non-emergency location")),
        ),
        _item(
            F.date_format(day, "MM-dd").isin(K.RULE_HOLIDAYS), 30,
            F.concat(F.lit("Service on holiday: "), F.date_format(day, "yyyy-MM-dd")),
        ),
        _item(
            known & ((hour < hours["start"]) | (hour > hours["end"])), 50,
            F.concat(F.lit("Service at "), clock, F.lit(" outside normal hours")),
        ),
        _item(
            ~known | (clock.isNotNull() & hour.isNull()), 20,
            F.concat(F.lit("Invalid date format: "), F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))),
        ),
        _where(
            F.size("red_flags") > 0,
            _items(
                F.filter(
                    "red_flags", lambda f: F.lower(f).contains("address") & F.lower(f).contains("exist")
                ),
                60, lambda f: F.lit("Patient address validation failed"),
            ),
        ),
    ]


def _location(limits: dict) -> list[Part]:
    ghost = F.coalesce(F.col("patient_id").contains("GHOST"), F.lit(False)) | F.coalesce(
        F.col("provider_id").contains("FRAUD"), F.lit(False)
    )
    return [
        _item(ghost, 90, F.lit("Ghost patient or fraudulent provider ID detected")),
        _flagged(
            ["appointment", "records", "closed"], 30, lambda f: F.concat(F.lit("Location issue: "), f)
        ),
    ]


def _unbundling(limits: dict) -> list[Part]:
    px = F.col("px")
    bundles = [
        _item(
            F.size(F.array_intersect(px, texts(codes))) > 1, 40,
            F.lit(f"Multiple {name} procedures that should be bundled"),
        )
        for name, codes in K.BUNDLES.items()
    ]
    others = F.col("overlaps")
    return [
        *bundles,
        Part(
            F.when(others > 0, (others * 50).cast("int")),
            F.when(
                others > 0,
                F.array(F.concat(F.lit("Duplicate procedures across claims: "), _number(others), F.lit(" other claims"))),
            ),
        ),
        _item(
            F.size(px) > limits["max_procedures_per_claim"], 30,
            F.concat(F.lit("Excessive procedures in single claim: "), _number(F.size(px))),
        ),
    ]


def _accident(limits: dict) -> list[Part]:
    dx, concerned = F.col("dx"), F.col("accident_concerned")
    pattern = F.lit(False)
    for codes in K.STAGED_PATTERNS:
        pattern = pattern | (F.size(F.array_except(texts(codes), dx)) == 0)
    return [
        _item(concerned & F.col("many_similar"), 40, F.lit("Multiple similar auto accidents")),
        _where(
            concerned,
            _flagged(
                ["relationship", "prior", "staged"], 50,
                lambda f: F.concat(F.lit("Staged accident indicator: "), f),
            ),
        ),
        _item(concerned & pattern, 30, F.lit("Consistent injury pattern across multiple claims")),
    ]


def _prescription(limits: dict) -> list[Part]:
    px, prescribed = F.col("px"), F.col("prescribed")
    adequate = F.arrays_overlap("dx", texts(K.ADEQUATE_DIAGNOSES))
    return [
        _item(
            prescribed > limits["prescription_daily_limit"], 50,
            F.concat(F.lit("Excessive prescription count: "), _number(prescribed)),
        ),
        _where(
            F.arrays_overlap(px, texts(K.CONTROLLED_CODES)) & ~adequate,
            _items(
                F.filter(px, lambda c: c.isin(K.CONTROLLED_CODES)), 60,
                lambda c: F.concat(F.lit("Controlled substance "), c, F.lit(" without adequate diagnosis")),
            ),
        ),
        _item(F.col("shopping"), 70, F.lit("Doctor shopping pattern detected")),
    ]


def _kickback(limits: dict) -> list[Part]:
    share = F.col("concentration")
    return [
        _item(
            share > limits["referral_concentration_threshold"], 40,
            F.concat(F.lit("High referral concentration: "), F.format_string("%.2f", share)),
        ),
        _item(F.col("circular"), 50, F.lit("Circular referral pattern detected")),
        _flagged(
            ["kickback", "referral", "relationship"], 60,
            lambda f: F.concat(F.lit("Kickback indicator: "), f),
        ),
    ]


def _frequency(limits: dict) -> list[Part]:
    return [
        _item(
            F.col("provider_today") > limits["max_daily_claims_per_provider"], 40,
            F.concat(F.lit("Excessive daily claims: "), _number(F.col("provider_today"))),
        ),
        _item(
            F.col("patient_today") > limits["max_patient_visits_per_day"], 30,
            F.concat(F.lit("Excessive patient visits: "), _number(F.col("patient_today"))),
        ),
    ]


def _amount(limits: dict) -> list[Part]:
    amount, expected = F.col("billed_amount"), F.col("expected")
    return [
        _item(
            amount > limits["max_amount_per_claim"], 50,
            F.concat(F.lit("Excessive claim amount: $"), _number(amount)),
        ),
        _item(
            (expected > 0) & (amount > expected * 2), 40,
            F.concat(
                F.lit("Amount $"), _number(amount), F.lit(" significantly exceeds expected $"), _number(expected)
            ),
        ),
        _item(
            (amount % 100 == 0) & (amount > 500), 20,
            F.concat(F.lit("Suspiciously round billing amount: $"), _number(amount)),
        ),
    ]


BUILDERS = {
    "upcoding_complexity": _upcoding,
    "phantom_billing_schedule": _schedule,
    "phantom_billing_location": _location,
    "unbundling_detection": _unbundling,
    "staged_accident_pattern": _accident,
    "prescription_fraud_volume": _prescription,
    "kickback_referral_pattern": _kickback,
    "billing_frequency_anomaly": _frequency,
    "amount_anomaly": _amount,
}

# columns several rules or several parts of a rule use: name -> (claim column, expression)
_SHARED = {
    "px": ("procedure_codes", lambda: or_empty("procedure_codes")),
    "dx": ("diagnosis_codes", lambda: or_empty("diagnosis_codes")),
}
_DERIVED = {
    "upcoding_complexity": {"progression": lambda: is_progression(F.col("px"))},
    "staged_accident_pattern": {
        "accident_concerned": lambda: (F.col("claim_type") == "auto")
        | F.arrays_overlap("dx", texts(K.AUTO_INJURY_CODES))
    },
    "prescription_fraud_volume": {
        "prescribed": lambda: F.size(F.filter("px", lambda c: c.isin(K.PRESCRIPTION_CODES)))
    },
    "amount_anomaly": {"expected": lambda: expected_amount(F.col("px"))},
}

def _evaluated(claims: DataFrame, config: RuleConfig, names: list[str]) -> DataFrame:
    """Per claim the points of each rule and its evidence.

    Points are plain arithmetic over the conditions, in a projection of their own. Evidence is made
    of claims with points only, and not at all where nothing uses it.
    """
    parts = {name: BUILDERS[name](config.thresholds) for name in names}

    def total(name: str) -> Column:
        return sum((F.coalesce(part.points, F.lit(0)) for part in parts[name]), F.lit(0))

    def evidence(name: str) -> Column:
        found = F.concat(*[F.coalesce(part.evidence, empty_texts()) for part in parts[name]])
        return F.when(F.col(f"{name}_points") > 0, found).otherwise(empty_texts())

    rows = with_context(claims, config, names)
    shared = {n: build() for n, (c, build) in _SHARED.items() if c in claims.columns}
    derived = {n: build() for name in names for n, build in _DERIVED.get(name, {}).items()}
    return (
        rows.withColumns(shared)
        .withColumns(derived)
        .withColumns({f"{name}_points": total(name) for name in names})
        .select("claim_id", *[f"{name}_points" for name in names], *[evidence(name).alias(name) for name in names])
    )


def _results(config: RuleConfig, names: list[str]) -> Column:
    """The array of rule results over the columns of ``_evaluated``."""

    def result(name: str) -> Column:
        rule = config.rules[name]
        return F.struct(
            F.lit(name).alias("rule_name"),
            F.lit(rule["fraud_type"]).alias("fraud_type"),
            F.col(f"{name}_points").alias("points"),
            (F.col(f"{name}_points") >= points(rule["threshold"])).alias("triggered"),
            F.col(name).alias("evidence"),
            F.lit(points(rule["weight"])).alias("weight"),
        )

    return F.array(*[result(name) for name in names])


def rule_results(claims: DataFrame, config: RuleConfig | None = None, names: list[str] | None = None) -> DataFrame:
    """Long table claim x enabled rule with score, trigger and evidence."""
    config = config or RuleConfig()
    names = [n for n in config.enabled() if names is None or n in names]
    # not of a named column: Spark would filter by its size first, and evaluate every rule again for that
    return (
        _evaluated(claims, config, names)
        .select("claim_id", F.inline(_results(config, names)))
        .select(
            "claim_id", "rule_name", "fraud_type", (F.col("points") / 100).alias("score"),
            "triggered", "evidence",
        )
    )


def rule_scores(claims: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Per claim: weighted score over the enabled rules, band, and triggered evidence."""
    config = config or RuleConfig()
    names = config.enabled()
    weights = sum(points(config.rules[name]["weight"]) for name in names)
    score, triggered = F.col("rule_score"), {name: F.col(f"{name}_points") >= points(config.rules[name]["threshold"]) for name in names}
    weighted = sum((F.col(f"{name}_points") * points(config.rules[name]["weight"]) for name in names), F.lit(0))
    hits = sum((F.when(hit, 1).otherwise(0) for hit in triggered.values()), F.lit(0))
    said = [F.when(hit, F.col(name)).otherwise(empty_texts()) for name, hit in triggered.items()]
    return (
        _evaluated(claims, config, names)
        .select(
            "claim_id",
            (weighted / (100.0 * weights) if weights else F.lit(0.0)).alias("rule_score"),
            hits.cast("long").alias("rules_triggered"),
            (F.concat(*said) if said else empty_texts()).alias("evidence"),
        )
        .withColumn("risk_band", F.when(score < 0.3, "Low").when(score < 0.7, "Medium").otherwise("High"))
    )


def rule_statistics(claims: DataFrame, config: RuleConfig | None = None) -> DataFrame:
    """Per fraud type: rules, enabled rules, and claims they triggered on."""
    config = config or RuleConfig()
    kinds = sorted({rule["fraud_type"] for rule in config.rules.values()})
    counted = F.array(
        *[
            F.struct(
                F.lit(kind).alias("fraud_type"),
                F.lit(sum(r["fraud_type"] == kind for r in config.rules.values())).cast("long").alias("total_rules"),
                F.lit(sum(r["fraud_type"] == kind and r["enabled"] for r in config.rules.values()))
                .cast("long").alias("enabled_rules"),
            )
            for kind in kinds
        ]
    )
    triggered = (
        rule_results(claims, config).where("triggered").groupBy("fraud_type").agg(F.count(F.lit(1)).alias("hits"))
    )
    catalogue = claims.sparkSession.range(1).select(F.inline(counted))
    return catalogue.join(triggered, "fraud_type", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))

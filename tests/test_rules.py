"""Rules on hand-made claims, at and around their thresholds."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from claimscope.operators import rules as R
from claimscope.sources.files import CLAIM_SCHEMA

BASE = {
    "claim_id": "CLM-2024-A1", "patient_id": "PAT-1", "provider_id": "PRV-1",
    "date_of_service": datetime.date(2024, 3, 13), "day_of_week": "Wednesday", "time_of_service": "10:00",
    "service_location": "11", "claim_type": "professional", "billed_amount": 100,
    "procedure_codes": ["99213"], "diagnosis_codes": ["J00"], "red_flags": [],
}


def claims(spark, *changes):
    rows = []
    for i, change in enumerate(changes):
        row = {**BASE, "claim_id": f"CLM-2024-A{i:03d}", **change}
        if row["billed_amount"] is not None:
            from decimal import Decimal

            row["billed_amount"] = Decimal(str(row["billed_amount"]))
        rows.append(tuple(row.get(f.name) for f in CLAIM_SCHEMA.fields))
    return spark.createDataFrame(rows, CLAIM_SCHEMA)


def results(spark, rule, *changes, config=None):
    out = R.rule_results(claims(spark, *changes), config, [rule]).orderBy("claim_id").collect()
    return [(round(r["score"], 2), r["triggered"]) for r in out]


@pytest.mark.parametrize(
    "codes,expected",
    [
        (["99213", "99214", "99215"], True), (["99213", "99280", "99215"], False), (["99213"], False), ([], False),
        (["99214", "99213"], True), (["99213", "99213"], False), (["J1", "K2", "x"], True),
    ],
)
def test_progression(spark, codes, expected):
    df = spark.createDataFrame([(codes,)], "codes array<string>")
    assert df.select(R.is_progression(F.col("codes"))).first()[0] is expected


def test_upcoding(spark):
    found = results(
        spark, "upcoding_complexity",
        {"procedure_codes": ["99215"], "diagnosis_codes": ["I10"]},
        {"procedure_codes": ["99215"], "diagnosis_codes": ["I10", "E11.9"]},
        {"procedure_codes": ["99215"], "diagnosis_codes": ["I10"], "billed_amount": 450.01},
        {"procedure_codes": ["99215"], "diagnosis_codes": ["I10"], "billed_amount": 450},
    )
    assert found == [(0.3, False), (0.6, False), (0.7, True), (0.3, False)]


def test_schedule(spark):
    found = results(
        spark, "phantom_billing_schedule",
        {"day_of_week": "Sunday"},
        {"day_of_week": "Sunday", "service_location": "23"},
        {"date_of_service": datetime.date(2024, 12, 25), "time_of_service": "05:59"},
        {"time_of_service": "22:30"}, {"time_of_service": "23:00"}, {"time_of_service": "06:00"},
        {"time_of_service": "late", "day_of_week": "Saturday"},
        {"date_of_service": None, "day_of_week": "Saturday"},
        {"red_flags": ["Patient ADDRESS does not EXIST"], "time_of_service": "03:00"},
        {"time_of_service": None},
    )
    assert found == [
        (0.4, False), (0.0, False), (0.8, True), (0.0, False), (0.5, False), (0.0, False),
        (0.6, False), (0.2, False), (1.1, True), (0.0, False),
    ]


def test_location_counts_flags_exactly(spark):
    flags = ["office closed", "no appointment", "records missing"]
    found = results(
        spark, "phantom_billing_location",
        {"patient_id": "PAT-GHOST-1"}, {"provider_id": "PRV-FRAUD-1"}, {"red_flags": flags[:2]}, {"red_flags": flags},
    )
    assert found == [(0.9, True), (0.9, True), (0.6, False), (0.9, True)]


def test_unbundling_across_claims(spark):
    same = {"procedure_codes": ["45378", "45380"]}
    found = results(
        spark, "unbundling_detection",
        same, {"procedure_codes": ["45378"]}, {"procedure_codes": ["45378"]},
        {"procedure_codes": ["45378"], "patient_id": "PAT-2"}, {"procedure_codes": None},
    )
    # two other claims share a code with each of the first three
    assert found == [(1.4, True), (1.0, True), (1.0, True), (0.0, False), (0.0, False)]


def test_overlaps_equal_brute_force(spark):
    import random

    random.seed(1)
    pool = [str(c) for c in range(6)]
    data = [
        {"procedure_codes": random.sample(pool, random.randint(0, 3)), "patient_id": f"PAT-{random.randint(1, 3)}"}
        for _ in range(60)
    ]
    df = claims(spark, *data)
    got = R.with_context(df, R.RuleConfig(), ["unbundling_detection"]).select("claim_id", "overlaps").collect()
    order = [*R.DAY, "codes", "overlaps"]
    few, many = (sorted(R.same_day_overlaps(df, n).select(*order).collect()) for n in (200, 1))
    assert few == many
    rows = df.select("claim_id", "patient_id", "procedure_codes").collect()
    for claim_id, overlaps in got:
        me = next(r for r in rows if r["claim_id"] == claim_id)
        others = sum(
            bool(set(me["procedure_codes"]) & set(r["procedure_codes"]))
            for r in rows if r["claim_id"] != claim_id and r["patient_id"] == me["patient_id"]
        )
        assert (overlaps or 0) == others


def test_staged_accidents(spark):
    auto = {"claim_type": "auto", "diagnosis_codes": ["S72.001A"]}
    found = results(
        spark, "staged_accident_pattern", auto, auto, auto,
        {**auto, "diagnosis_codes": ["S72.001A", "S06.0X0A"], "red_flags": ["prior relationship"]},
    )
    assert found == [(0.4, False), (0.4, False), (0.4, False), (1.2, True)]
    assert results(spark, "staged_accident_pattern", auto, auto, auto) == [(0.0, False)] * 3
    assert results(spark, "staged_accident_pattern", {"red_flags": ["staged"]}) == [(0.0, False)]


def test_similar_accidents_counts_over_rare_codes(spark):
    auto = {"claim_type": "auto"}
    df = claims(
        spark,
        *[{**auto, "diagnosis_codes": ["A"]} for _ in range(2)],
        *[{**auto, "diagnosis_codes": ["B"]} for _ in range(2)],
        {"diagnosis_codes": ["A", "B"]}, {"diagnosis_codes": ["A"]},
    )
    # two claims per code, four together
    assert [r["claim_id"] for r in R.similar_accidents(df).collect()] == ["CLM-2024-A004"]


def test_prescription(spark):
    found = results(
        spark, "prescription_fraud_volume",
        {"procedure_codes": ["J1170", "J2405"], "diagnosis_codes": ["J00"]},
        {"procedure_codes": ["J1170"], "diagnosis_codes": ["G89.29"]},
        {"procedure_codes": ["J1100", "J2001", "J3420", "J7799"]},
    )
    assert found == [(1.2, True), (0.0, False), (0.0, False)]


def test_doctor_shopping_needs_six(spark):
    visits = [{"provider_id": f"PRV-{i}"} for i in range(6)]
    assert [t for _, t in results(spark, "prescription_fraud_volume", *visits)] == [False] * 5 + [True]


def test_kickback(spark):
    to = lambda a, b, **more: {"provider_id": a, "referred_to_provider": b, **more}
    found = results(
        spark, "kickback_referral_pattern",
        to("A", "B"), to("B", "A"), to("C", "D", procedure_codes=["J1100"]), {"red_flags": ["kickback"]},
    )
    assert found == [(0.9, True), (0.9, True), (0.0, False), (0.6, False)]


def test_frequency(spark):
    config = R.RuleConfig().override({"thresholds": {"max_daily_claims_per_provider": 2}})
    found = results(spark, "billing_frequency_anomaly", *[{}] * 5, config=config)
    assert found == [(0.0, False), (0.0, False), (0.4, False), (0.7, True), (0.7, True)]


def test_amount(spark):
    found = results(
        spark, "amount_anomaly",
        {"billed_amount": 10000}, {"billed_amount": 10000.01}, {"billed_amount": 500}, {"billed_amount": 250},
        {"billed_amount": 600, "procedure_codes": []}, {"billed_amount": None},
    )
    assert found == [(0.6, False), (0.9, True), (0.4, False), (0.0, False), (0.2, False), (0.0, False)]


def test_malformed_claim_scores_safely(spark):
    empty = {k: None for k in BASE}
    out = R.rule_scores(claims(spark, {**empty, "claim_id": "X"})).first()
    assert 0.0 <= out["rule_score"] <= 1.0 and out["risk_band"] == "Low"


def test_config_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": {"amount_anomaly": {"enabled": False}, "other": {"weight": 1}},
                                "thresholds": {"max_amount_per_claim": 5}}))
    config = R.RuleConfig.load(str(path))
    assert "amount_anomaly" not in config.enabled() and len(config.enabled()) == 8
    assert config.thresholds["max_amount_per_claim"] == 5 and "other" not in config.rules

"""The chunked paths for big keys give the rows of the plain window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.functions import skew
from claimscope.operators.features import provider_switches, sequence_positions
from claimscope.operators.rules import doctor_shopping


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(7)
    # one key holds a third of the rows, many of them on one date
    data = [("hot" if i % 3 == 0 else f"k{i % 50}", i % 4 if i % 3 == 0 else i % 90, i) for i in range(3000)]
    random.shuffle(data)
    return spark.createDataFrame(data, "k string, day int, id int")


def test_sequence_of_big_keys(rows):
    plain = skew.with_sequence(rows, ["k"], ["day", "id"], "n")
    chunked = skew.with_sequence(rows, ["k"], ["day", "id"], "n", limit=100)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, chunked.collect()))


@pytest.mark.parametrize("width", [1, 2, 30])
def test_frames_of_big_keys(rows, width):
    def columns(frame):
        return {"total": F.sum("id").over(frame), "n": F.count(F.lit(1)).over(frame)}

    plain = skew.over_recent(rows, ["k"], ["day", "id"], width, columns)
    chunked = skew.over_recent(rows, ["k"], ["day", "id"], width, columns, limit=64)
    assert sorted(map(tuple, plain.select(*chunked.columns).collect())) == sorted(map(tuple, chunked.collect()))


def test_running_total_over_the_table(rows):
    out = skew.running_total(rows, [], ["day", "id"], "id", "upto").orderBy("day", "id").collect()
    total = 0
    for row in out:
        total += row["id"]
        assert row["upto"] == total


@pytest.mark.parametrize("kind", ["uniform", "ties", "spread", "constant", "single"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "uniform": rng.uniform(-5, 5, 5001),
        "ties": rng.integers(0, 4, 4000).astype(float),
        "spread": 10 ** rng.uniform(-30, 30, 3000),
        "constant": np.full(100, 2.5),
        "single": np.array([7.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").union(
        spark.createDataFrame([(None,)], "v double")
    )
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 0.95, 0.99, 1.0]
    found = skew.quantiles(df, {"v": probs})["v"]
    for p in probs:
        assert found[p] == pytest.approx(float(np.quantile(values, p)), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert skew.quantiles(spark.createDataFrame([], "v double"), {"v": [0.5]}) == {"v": {0.5: None}}


def test_average_rank_equals_pandas(spark, rows):
    pdf = rows.toPandas()
    out = skew.with_average_rank(rows, "day", "r").toPandas().set_index("id")["r"].sort_index()
    expected = pdf.set_index("id")["day"].rank(pct=True).sort_index()
    assert np.allclose(out, expected)
    within = skew.with_average_rank(rows, "day", "r", ["k"]).toPandas().set_index("id")["r"].sort_index()
    expected = pdf.set_index("id").groupby("k")["day"].rank(pct=True).sort_index()
    assert np.allclose(within, expected)


def test_sorted_codes(rows):
    out = {r["k"]: r["c"] for r in skew.with_sorted_code(rows, "k", "c").select("k", "c").distinct().collect()}
    assert out == {k: i for i, k in enumerate(sorted(out))}


def test_operators_agree_on_both_paths(spark, rows):
    claims = rows.select(
        F.format_string("C%06d", "id").alias("claim_id"),
        F.col("k").alias("patient_id"),
        F.concat(F.lit("P"), (F.col("id") * 7 % 11).cast("string")).alias("provider_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("date_of_service"),
    )
    for operator in (sequence_positions, provider_switches, doctor_shopping):
        plain = operator(claims)
        chunked = operator(claims, limit=64)
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, chunked.collect()))

"""Cases in which earlier versions lost rows, counts or an end."""

import math

from pyspark.sql import functions as F

from claimscope.functions.skew import quantiles, with_sequence
from claimscope.operators import graph, similarity
from tests.test_rules import results


def test_null_keys_are_numbered_on_both_paths(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else "a", i) for i in range(30)], "k string, v int")
    plain = sorted(map(tuple, with_sequence(df, ["k"], ["v"], "n").collect()), key=str)
    chunked = sorted(map(tuple, with_sequence(df, ["k"], ["v"], "n", limit=2).collect()), key=str)
    assert plain == chunked and len(chunked) == 30


def test_quantiles_of_infinite_and_missing_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, inf, -inf, float("nan"), None)], "v double")
    found = quantiles(df, {"v": [0.0, 0.25, 0.5, 0.75, 1.0]})["v"]
    assert found == {0.0: -inf, 0.25: 1.0, 0.5: 2.0, 0.75: 3.0, 1.0: inf}
    assert math.isinf(quantiles(df.where("v > 3 AND v = v AND NOT isnan(v)"), {"v": [0.5]})["v"][0.5])


def test_betweenness_is_exact_unless_asked_otherwise(spark):
    assert not hasattr(graph, "EXACT_PAIRS")


def test_search_in_blocks_gives_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)], "id long, vector array<double>")
    asked = rows.where("id % 4 = 0").select(F.col("id").alias("query_id"), "vector")
    whole = sorted(map(tuple, similarity.search(rows, asked, "id", "vector", k=3).collect()))
    monkeypatch.setattr(similarity, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, similarity.search(rows, asked, "id", "vector", k=3).collect())) == whole


def test_repeated_codes_count_each_time(spark):
    upcoding = {"procedure_codes": ["99215"] * 3, "diagnosis_codes": ["I10"], "billed_amount": 400}
    assert results(spark, "upcoding_complexity", upcoding) == [(0.9, True)]
    few, many = ({"procedure_codes": ["J1100"] * n, "diagnosis_codes": ["J00"]} for n in (5, 6))
    assert [s for s, _ in results(spark, "prescription_fraud_volume", few, many)] == [0.0, 0.5]

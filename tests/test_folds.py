"""Folds are dealt once and stored, scores are ranked in one pass."""

import pytest

from claimscope.functions import skew
from claimscope.operators import classify


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, float(i % 7), float(i * i % 11), i % 3 == 0) for i in range(90)], "id int, a double, b double, y boolean")


def test_folds_are_not_dealt_again_for_every_model(rows, monkeypatch):
    plans, train = [], classify.train
    monkeypatch.setattr(classify, "train", lambda part, *a, **b: plans.append(part._jdf.queryExecution().optimizedPlan().toString()) or train(part, *a, **b))
    classify.cross_validate(rows, "id", "logistic_regression", ["a", "b"], "y", 2, maxIter=3)
    assert len(plans) == 2 and not any("Window" in plan or "Join" in plan for plan in plans)


def test_both_running_totals_of_the_metrics_share_one_order(rows, monkeypatch):
    made, chunks = [], skew.ordered_chunks
    monkeypatch.setattr(skew, "ordered_chunks", lambda *a: made.append(1) or chunks(*a))
    classify.ranking_metrics(rows, "a", "y").collect()
    assert len(made) == 1


def test_running_totals_of_two_weights(rows):
    found = skew.running_totals(rows, ["y"], ["id"], {"a": "upto_a", "b": "upto_b"}).orderBy("id").collect()
    sums = {True: [0, 0], False: [0, 0]}
    for r in found:
        sums[r["y"]] = [sums[r["y"]][0] + r["a"], sums[r["y"]][1] + r["b"]]
        assert [r["upto_a"], r["upto_b"]] == sums[r["y"]]


def test_training_rows_are_dealt_evenly(spark):
    cores = spark.sparkContext.defaultParallelism
    lopsided = spark.range(0, 20_000, 1, 3).where("id % 3 = 0 OR id < 6000")
    parts = classify.dealt_evenly(lopsided).rdd.glom().map(len).collect()
    assert len(parts) == cores and max(parts) <= 1.1 * min(parts)
    assert classify.dealt_evenly(spark.range(0, 100, 1, 3)).rdd.getNumPartitions() == 3

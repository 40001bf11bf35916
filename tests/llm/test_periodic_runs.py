"""Periodic runs against a search at every period."""

import random

import pyarrow as pa
import pytest

from claimscope.llm import periodic_runs
from tests.compare import connect, differences


def plain_runs(words, least_length=24, least_periods=3):
    found = {}
    for q in range(1, len(words) // least_periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_length, least_periods * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((start, q, length) for (start, length), q in found.items())


def _text(dice):
    words = []
    for _ in range(dice.randint(1, 6)):
        if dice.random() < 0.5:
            words += [dice.choice("abc") for _ in range(dice.randint(0, 30))]
            continue
        period = [dice.choice(["a", "b", "aa"] if dice.random() < 0.7 else list("abcdefgh")) for _ in range(dice.randint(1, 40))]
        if dice.random() < 0.4:  # a period that is itself periodic in parts
            period = ["a", "b"] * dice.randint(4, 20) + ["c"] + ["a", "b"] * dice.choice([0, dice.randint(4, 20)])
        words += (period * 7)[: dice.randint(1, 6 * len(period))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_against_every_period(seed):
    dice = random.Random(seed)
    texts = [_text(dice) for _ in range(dice.randint(1, 6))] + [[]]
    n_words, runs, collapsed = periodic_runs._of_texts(pa.array([" ".join(t) for t in texts] + [None], pa.string()), 24, 3)
    for words, n, found, left in zip(texts, n_words.to_pylist(), runs.to_pylist(), collapsed.to_pylist()):
        expected = plain_runs(words)
        assert n == len(words) and [(r["start"], r["period"], r["length"]) for r in found] == expected
        dropped = {i for start, q, length in expected for i in range(start + q, start + length)}
        assert left == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_long_runs_and_many_levels():
    dice = random.Random(9)
    for period in (1, 7, 8, 15, 16, 100, 700):
        words = [str(dice.randint(0, 99)) for _ in range(37)] + ([str(dice.randint(0, 9)) for _ in range(period)] * 5000)[: 3 * period + 11 + 2000]
        _, runs, _ = periodic_runs._of_texts(pa.array([" ".join(words)]), 24, 3)
        best = max(runs.to_pylist()[0], key=lambda r: r["length"])
        q = best["period"]
        assert period % q == 0 and best["length"] >= 3 * period + 2011 and all(words[i] == words[i + q] for i in range(best["start"], best["start"] + best["length"] - q))


def test_odd_rows(spark):
    long = " ".join(["na"] * 50_000)
    rows = [(None, None, 1), (1, "", 2), (1, " \n\t", 3), (2, long, 4), (2, long, 5), (None, "a b " * 20, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int")
    found = sorted(periodic_runs.periodic_runs(docs).collect(), key=str)
    assert sorted((str(r["doc_id"]), r["n_words"], len(r["runs"]), r["collapsed"]) for r in found) == sorted(
        [("None", 0, 0, ""), ("1", 0, 0, ""), ("1", 0, 0, ""), ("2", 50_000, 1, "na"), ("2", 50_000, 1, "na"), ("None", 40, 1, "a b")]
    )
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_texts_do_not_join(spark):
    """Equal texts side by side, in one batch, are no run of one another."""
    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine ten") for i in range(9)], "doc_id int, text string").coalesce(1)
    assert all(r["runs"] == [] for r in periodic_runs.periodic_runs(docs).collect())


def test_query_against_sql(spark, sf_dir):
    from claimscope.llm.queries import registry

    assert differences(registry.queries["op12_periodic_runs"](spark, sf_dir), connect(sf_dir), registry.sql["op12_periodic_runs"]) is None

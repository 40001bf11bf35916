"""Encoders with any number of values, sliding counts and split patients against plain code."""

import datetime
import random

from pyspark.sql import functions as F

from claimscope.operators import graph, marts
from claimscope.operators.preprocessing import Preprocessor, one_hot_entries, value_places


def test_a_hundred_thousand_values(spark):
    rows = spark.range(300_000).select("id", F.format_string("v%06d", F.col("id") % 100_000).alias("c"))
    fitted = Preprocessor([], ["c"]).fit(rows)
    assert fitted.sizes == {"c": 100_000} and fitted.categories == {} and fitted.modes == {"c": "v000000"}
    new = spark.createDataFrame([(1, "v000000"), (2, "v000001"), (3, "v099999"), (4, "other"), (5, None)], "id int, c string")
    codes = {r["id"]: r["c_code"] for r in fitted.label_encode(new).collect()}
    assert codes == {1: 0, 2: 1, 3: 99_999, 4: None, 5: None}
    hot = {r["id"]: r["c_hot"] for r in fitted.one_hot(new).collect()}
    assert hot == {1: None, 2: 0, 3: 99_998, 4: None, 5: None}
    entries = one_hot_entries(new, "id", fitted.places, ["c"]).collect()
    assert sorted(map(tuple, entries)) == [(2, "c", 1), (3, "c", 99_999)]


def test_both_ways_of_encoding_agree(spark):
    rows = spark.createDataFrame([(i, random.Random(i).choice(["a", "b", "c", None])) for i in range(60)], "id int, c string")
    wide, table = Preprocessor([], ["c"]).fit(rows), Preprocessor([], ["c"], wide_categories=0).fit(rows)
    assert wide.modes == table.modes
    assert sorted(wide.label_encode(rows).collect(), key=str) == sorted(table.label_encode(rows).collect(), key=str)
    hot = {r["id"]: r["c_hot"] for r in table.one_hot(rows).collect()}
    for r in wide.one_hot(rows).collect():
        assert (r["c_b"], r["c_c"]) == (int(hot[r["id"]] == 0), int(hot[r["id"]] == 1))


def test_columns_without_values(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    fitted = Preprocessor([], ["c"]).fit(rows)
    assert fitted.modes == {"c": None} and fitted.sizes == {"c": 0}
    assert [r["c_code"] for r in fitted.label_encode(rows).collect()] == [None, None]
    assert fitted.one_hot(rows).columns == ["id", "c"]
    assert value_places(rows.limit(0), ["c"]).count() == 0


def test_keys_in_the_last_days(spark):
    draw = random.Random(5)
    first = datetime.date(2024, 1, 1)
    rows = [
        (i, draw.choice(["hot", "hot", "p1", "p2", None]), first + datetime.timedelta(draw.randrange(120)), draw.choice(["a", "b", "c", "d", "e", None]))
        for i in range(250)
    ] + [(900, "p1", None, "a")]
    claims = spark.createDataFrame(rows, "claim_id int, patient_id string, date_of_service date, npi string")
    for days in (0, 1, 7, 30):
        wanted = {}
        for claim, patient, day, _ in rows:
            if patient and day:
                near = {w for _, p, d, w in rows if p == patient and d and w and 0 <= (day - d).days <= days}
                if len(near) > 1:
                    wanted[claim] = len(near)
        found = marts.crowded_prescribers(claims, "npi", days, 1).collect()
        assert {r["claim_id"]: r["prescribers"] for r in found} == wanted


def test_a_patient_with_many_providers_is_split(spark):
    draw = random.Random(3)
    rows = [("hot", f"v{i:03}") for i in range(120)] + [("hot", "v000")] * 2
    rows += [(f"p{draw.randrange(60)}", f"v{draw.randrange(150):03}") for _ in range(500)]
    claims = spark.createDataFrame(rows, "patient_id string, provider_id string")
    whole, split = graph.edges(claims), graph.edges(claims, block=10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    assert sorted(map(tuple, graph.degrees(claims).collect())) == sorted(map(tuple, graph.degrees(claims, 10).collect()))
    keys = graph.blocked_pairs(graph.incidences(claims), 10).groupBy("patient_id", "i", "j").count()
    assert keys.agg(F.max("count")).first()[0] <= 4 * 10 * 10

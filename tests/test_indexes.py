"""Vector index, bucketed table and sketches against exact results."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import graph, similarity
from claimscope.session import scratch_path


def pairs(found):
    return {(r["query_id"], r["vec_id"]) for r in found.select("query_id", "vec_id").collect()}


def test_recall_of_the_index_on_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    path = scratch_path(spark)
    similarity.build_index(rows, path, "vec_id", "embedding")
    assert spark.read.parquet(f"{path}/rows").count() == rows.count()
    exact = pairs(similarity.search(rows, queries, "vec_id", "embedding", threshold=0.0))
    found = similarity.search_index(path, queries, "vec_id", "embedding", threshold=0.0)
    assert len(exact & pairs(found)) >= 0.9 * len(exact)
    assert pairs(similarity.search_index(path, queries, "vec_id", "embedding", threshold=0.0, probes=64)) == exact


def test_clustered_vectors_need_few_lists(spark):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(30, 16))
    data = [(i, [float(x) for x in centers[i % 30] + 0.1 * draw.normal(size=16)]) for i in range(3000)]
    # copies of one vector, a null and a zero vector
    data += [(3000 + i, data[7][1]) for i in range(400)] + [(5000, None), (5001, [0.0] * 16)]
    rows = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    queries = rows.where("vec_id % 20 = 0 AND vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    path = scratch_path(spark)
    similarity.build_index(rows, path, "vec_id", "embedding", lists=40, sample=1000)
    assert spark.read.parquet(f"{path}/rows").count() == 3400
    exact = pairs(similarity.search(rows.where("vec_id < 5000"), queries, "vec_id", "embedding", threshold=0.5))
    found = pairs(similarity.search_index(path, queries, "vec_id", "embedding", threshold=0.5, probes=5))
    assert len(exact & found) >= 0.9 * len(exact)
    assert similarity.probed_share(path, queries, probes=5) < 0.35


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_touches_only_its_buckets(spark):
    schema = "id int, version int, body string"
    first = spark.createDataFrame([(i, 1, f"a{i}") for i in range(200)], schema)
    path = scratch_path(spark)
    similarity.write_bucketed(first.limit(0).withColumn("batch", F.lit(0).cast("long")), path, "id", 8)
    similarity.upsert_into(path, first, "id", "version", 1, 8)
    table = spark.read.schema(f"{schema}, batch long, bucket int")
    before = files(path)
    change = spark.createDataFrame([(5, 2, "b5"), (5, 3, "c5"), (6, 0, "old"), (900, 1, "new")], schema)
    similarity.upsert_into(path, change, "id", "version", 2, 8)
    wanted = {i: (1, f"a{i}", 1) for i in range(200)} | {5: (3, "c5", 2), 900: (1, "new", 2)}
    assert {r["id"]: (r["version"], r["body"], r["batch"]) for r in table.parquet(path).collect()} == wanted
    touched = {r[0] for r in change.select(similarity.bucket_of("id", 8)).collect()}
    kept = {f for f in before if not any(f"bucket={b}/" in f for b in touched)}
    assert kept and all(files(path).get(f) == before[f] for f in kept)
    # the same batch once more, and an empty one
    similarity.upsert_into(path, change, "id", "version", 3, 8)
    similarity.upsert_into(path, change.limit(0), "id", "version", 4, 8)
    assert {r["id"]: (r["version"], r["body"], r["batch"]) for r in table.parquet(path).collect()} == wanted


def test_closeness_from_sketches_is_near_the_exact_one(spark):
    draw = random.Random(8)
    rows = [(str(p), f"v{draw.randrange(400):03}") for p in range(300) for _ in range(4)]
    claims = spark.createDataFrame([*rows, ("alone", "v999")], "patient_id string, provider_id string")
    exact = {r[0]: r[1] for r in graph.closeness(claims).collect()}
    found = {r["provider_id"]: r["provider_closeness_centrality"] for r in graph.closeness_estimates(claims).collect()}
    assert found.keys() == exact.keys() and found["v999"] == exact["v999"] == 0.0
    assert all(found[p] == pytest.approx(exact[p], rel=0.1) for p in exact)


def test_only_the_best_rows_of_a_query_are_kept():
    draw = np.random.default_rng(6)
    scores = draw.integers(-3, 4, size=(500, 20)) / 4  # many ties
    ok = (scores >= 0) & (draw.random(scores.shape) < 0.7)
    ok[:, 3] = False
    row, query = similarity._first_rows(scores, ok, 10)
    for q in range(20):
        wanted = sorted((-scores[r, q], r) for r in np.flatnonzero(ok[:, q]))[:10]
        assert sorted((-scores[r, q], r) for r in row[query == q]) == wanted
    assert len(row) <= 10 * 20

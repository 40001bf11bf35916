"""Operators on small fixtures: graph, outliers, models, sources, streams, scoring."""

import datetime
import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.operators import classify, confidence, features, graph, history, outliers, scoring, similarity, text
from claimscope.sources import files
from claimscope.streaming import claims as streams


def seen(spark, pairs):
    return spark.createDataFrame(pairs, "patient_id string, provider_id string")


@pytest.fixture(scope="module")
def path_graph(spark):
    """A - B - C - D in a row, E alone, and a second visit of one patient to A."""
    return seen(spark, [("1", "A"), ("1", "B"), ("2", "B"), ("2", "C"), ("3", "C"), ("3", "D"), ("4", "E"), ("5", "A"), ("5", "A")])


def measure(df, column):
    return {r["provider_id"]: r[column] for r in df.collect()}


def test_edges_and_loops(path_graph):
    found = {(r["src"], r["dst"]): r["weight"] for r in graph.edges(path_graph).collect()}
    assert found == {("A", "B"): 1, ("B", "C"): 1, ("C", "D"): 1, ("A", "A"): 1}


def test_degrees(path_graph):
    out = graph.degrees(path_graph)
    assert measure(out, "provider_connections") == {"A": 2, "B": 2, "C": 2, "D": 1, "E": 0}
    share = measure(out, "provider_degree_centrality")
    assert share["A"] == pytest.approx(3 / 4) and share["D"] == pytest.approx(1 / 4)


def test_closeness_of_a_path(path_graph):
    found = measure(graph.closeness(path_graph), "provider_closeness_centrality")
    assert found["A"] == pytest.approx(3 / 6 * 3 / 4)
    assert found["B"] == pytest.approx(3 / 4 * 3 / 4)
    assert found["E"] == 0.0


def brute_betweenness(nodes, links):
    """Shortest paths listed one by one."""
    near = {n: {b for a, b in links if a == n} for n in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        level, found = [[s]], []
        visited = {s}
        while level and not found:
            found = [p for p in level if p[-1] == t]
            grown = [p + [n] for p in level for n in near[p[-1]] if n not in visited]
            visited |= {p[-1] for p in grown}
            level = grown
        for p in found:
            for n in p[1:-1]:
                score[n] += 1 / len(found)
    size = len(nodes)
    return {n: v / ((size - 1) * (size - 2)) for n, v in score.items()}


def test_betweenness_and_clustering_equal_brute_force(spark):
    random.seed(4)
    pairs = [(str(i), random.choice("ABCDEFGH")) for i in range(14) for _ in range(2)]
    df = seen(spark, pairs)
    table = graph.edges(df)
    links = {(r["src"], r["dst"]) for r in table.collect() if r["src"] != r["dst"]}
    links |= {(b, a) for a, b in links}
    nodes = sorted({p for _, p in pairs})
    providers = graph.incidences(df).select("provider_id").distinct()
    got = measure(graph.betweenness(table, providers), "provider_betweenness_centrality")
    assert got == pytest.approx(brute_betweenness(nodes, links))
    triangles = measure(graph.clustering(table, providers), "provider_clustering")
    for n in nodes:
        around = [b for a, b in links if a == n]
        closed = sum((a, b) in links for a, b in itertools.combinations(around, 2))
        size = len(around) * (len(around) - 1) / 2
        assert triangles[n] == pytest.approx(closed / size if size else 0.0)


# --- outliers ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(600, 2))
    points[:6] += 12
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id int, x double, y double")


def test_planted_outliers_are_found(cloud):
    normal = cloud.where("id >= 6")
    model = outliers.fit(normal, ["x", "y"])
    votes = outliers.statistical_votes(cloud, model)
    assert votes.where("id < 6 AND NOT statistical_outlier").count() == 0
    assert outliers.isolation_outliers(normal, cloud, "id", ["x", "y"]).where("id < 6 AND NOT isolation_outlier").count() == 0
    lof = outliers.local_outlier_factor(normal, cloud, "id", ["x", "y"])
    assert lof.where("id < 6 AND NOT lof_outlier").count() == 0
    robust = outliers.robust_covariance_outliers(normal, cloud, ["x", "y"])
    assert robust.where("id < 6 AND NOT covariance_outlier").count() == 0


def test_density_noise_equals_brute_force(spark, cloud):
    rows = cloud.select("id", F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    points = {r["id"]: (r["x"], r["y"]) for r in rows.collect()}

    def near(a, b):
        return (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 0.25

    core = {i for i, p in points.items() if sum(near(p, q) for q in points.values()) >= 5}
    noise = {i for i, p in points.items() if i not in core and not any(near(p, points[c]) for c in core)}
    got = {r["id"] for r in outliers.dbscan_noise(rows, "id", ["x", "y"]).where("is_noise").collect()}
    assert got == noise


def test_full_ensemble_and_noise_use_every_detector_and_feature(spark, sf_dir):
    from claimscope.plans import features as feature_plans
    from claimscope.plans import outliers as plans

    rows = {r["claim_id"]: [r[f] for f in plans.FEATURES] for r in plans._scaled(spark, sf_dir).collect()}
    places, counts = np.unique(np.array(list(rows.values())), axis=0, return_counts=True)
    near = ((places[:, None] - places[None]) ** 2).sum(-1) <= 0.25
    core = near @ counts >= 5
    lonely = {tuple(p) for p, c, b in zip(places, core, near @ core.astype(int)) if not c and not b}
    noise = {k for k, p in rows.items() if tuple(p) in lonely}
    assert {r["claim_id"] for r in plans.density_noise_all_features(spark, sf_dir).where("is_noise").collect()} == noise

    names = plans.VOTES
    out = plans.full_outlier_ensemble(spark, sf_dir).collect()
    assert len(names) == 8 and len(out) == len(rows)
    for r in out:
        votes = sum(r[m] for m in names)
        assert r["is_anomaly"] == (votes >= 4) and r["is_noise"] == (r["claim_id"] in noise)
    print("FIGURES", len(rows), len(noise), sum(r["is_anomaly"] for r in out))

    wide = feature_plans.feature_table(spark, sf_dir)
    assert wide.count() == len(rows) and len(wide.columns) > len(feature_plans.combined_features(spark, sf_dir).columns)
    print("COLUMNS", len(wide.columns), len(feature_plans.combined_features(spark, sf_dir).columns))


# --- models --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        y = i % 4 == 0
        a, b = rng.normal(2.5 if y else 0.0), rng.normal()
        rows.append((f"c{i}", float(a), float(b), y))
    return spark.createDataFrame(rows, "id string, a double, b double, y boolean")


def test_split_keeps_shares(labelled):
    parts = classify.stratified_split(labelled, "id", "y")
    counts = {(r["part"], r["y"]): r["count"] for r in parts.groupBy("part", "y").count().collect()}
    assert counts[("train", True)] == 60 and counts[("train", False)] == 180
    assert counts[("test", True)] == 20 and counts[("validation", False)] == 60
    with pytest.raises(ValueError):
        classify.stratified_split(labelled.where("y"), "id", "y")


@pytest.mark.parametrize("name", classify.MODELS)
def test_models_separate_the_classes(labelled, name):
    quick = {
        "random_forest": {"numTrees": 10, "maxDepth": 4}, "gradient_boosting": {"maxIter": 5, "maxDepth": 3},
        "neural_network": {"maxIter": 40}, "logistic_regression": {}, "linear_svm": {"maxIter": 20},
    }[name]
    model = classify.train(labelled, name, ["a", "b"], "y", **quick)
    found = classify.predict(model, labelled, ["a", "b"], "id", ["y"]).cache()
    assert found.where("fraud_probability < 0 OR fraud_probability > 1 OR confidence < 0.5").count() == 0
    metrics = classify.evaluate(found, "fraud_probability", "y").first()
    assert metrics["roc_auc"] > 0.9 and metrics["recall"] > 0.7


@pytest.mark.parametrize("n", [1, 2, 100, 1000])
def test_isolation_trees_have_whole_samples(spark, n):
    rows = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(n)], "id int, x double, y double")
    forest = outliers.isolation_trees(rows, "id", ["x", "y"], trees=10)
    assert [tree["size"] for tree in forest] == [min(n, 256)] * 10
    scores = [r[0] for r in outliers.isolation_scores(rows, "id", ["x", "y"], forest).select("isolation_score").collect()]
    assert len(scores) == n and all(0 < s <= 1 for s in scores)
    assert n > 2 or scores == [0.5] * n


def test_ranking_metrics(spark):
    data = [(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.2, True), (0.1, False)]
    out = classify.ranking_metrics(spark.createDataFrame(data, "s double, y boolean"), "s", "y").first()
    pairs = [(a, b) for a, x in data if x for b, y in data if not y]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert out["roc_auc"] == pytest.approx(auc)
    assert out["average_precision"] == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)


def test_oversampling_balances(labelled):
    out = classify.oversample(labelled, "id", "y", ["a", "b"])
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {True: 300, False: 300}
    made = out.where("synthetic").agg(F.min("a"), F.max("a")).first()
    real = labelled.where("y").agg(F.min("a"), F.max("a")).first()
    assert real[0] <= made[0] and made[1] <= real[1]


def test_model_round_trip(labelled, tmp_path):
    model = classify.train(labelled, "logistic_regression", ["a", "b"], "y")
    classify.save(model, str(tmp_path / "m"))
    again = classify.load(str(tmp_path / "m"))
    first = classify.predict(model, labelled, ["a", "b"], "id").orderBy("id").collect()
    assert first == classify.predict(again, labelled, ["a", "b"], "id").orderBy("id").collect()


def test_cross_validation_and_grid(labelled):
    out = {r["metric"]: r["mean"] for r in classify.cross_validate(labelled, "id", "logistic_regression", ["a", "b"], "y", 3).collect()}
    assert out["roc_auc"] > 0.9
    _, scores = classify.grid_search(labelled, "id", "logistic_regression", ["a", "b"], "y", folds=3)
    assert scores.count() == 3


# --- scoring and confidence -------------------------------------------------------------


def test_combined_levels(spark):
    rows = [("a", 1.0, 1.0, 1.0), ("b", 0.6, 0.8, 0.6), ("c", None, None, None), ("d", 0.0, 0.0, 20.0), ("e", 0.5, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "claim_id string, rule_score double, ml_score double, anomaly_score double")
    out = {r["claim_id"]: r for r in scoring.combine_scores(df).collect()}
    assert out["a"]["risk_level"] == "CRITICAL" and out["a"]["confidence_score"] == 1.0
    assert out["b"]["risk_level"] == "HIGH" and out["b"]["is_fraud"]
    assert out["c"]["fraud_probability"] == pytest.approx(0.25) and out["c"]["risk_level"] == "LOW"
    assert out["d"]["anomaly_score"] == 1.0
    assert out["e"]["risk_level"] == "MEDIUM"


def test_negative_age_is_an_error(spark):
    df = spark.createDataFrame([(0,), (120,)], "age int")
    assert [r[0] for r in df.select(confidence.temporal_relevance(F.col("age"))).collect()] == [1.0, 0.5]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-1,)], "age int").select(confidence.temporal_relevance(F.col("age"))).collect()


def test_search_orders_and_limits(spark):
    rows = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(20)], "id long, v array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    out = similarity.search(rows, queries, "id", "v", k=3, threshold=0.9).orderBy("rank").collect()
    assert [r["id"] for r in out] == [0, 1, 2]
    assert similarity.search(rows, queries, "id", "v", k=10, threshold=0.999).count() == 1


def test_upsert_keeps_the_latest(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, version int, body string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e")], "id int, version int, body string")
    out = {r["id"]: r["body"] for r in similarity.upsert(old, new, "id", "version").collect()}
    assert out == {1: "c", 2: "b", 3: "e"}


def test_history_pages(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(f"C{i:03d}", "P", day + datetime.timedelta(days=i % 7)) for i in range(25)]
    df = spark.createDataFrame(rows, "claim_id string, patient_id string, date_of_service date")
    pages = history.history_documents(df, page=10).orderBy("page").collect()
    assert [len(p["claim_sequence"]) for p in pages] == [10, 10, 5]
    order = [(e["date_of_service"], e["claim_id"]) for p in pages for e in p["claim_sequence"]]
    assert order == sorted(order) and len(order) == 25


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("1", "Severe pain, severe"), ("2", "pain"), ("3", "other words")], "claim_id string, notes string")
    out = {(r["claim_id"], r["term"]): r["weight"] for r in text.tfidf(df, stop_words=[]).collect()}
    assert out == {("1", "pain"): 1.0, ("2", "pain"): 1.0}


def test_all_families_side_by_side(spark):
    day = datetime.date(2024, 1, 1)
    rows = [
        (f"C{i}", f"P{i % 2}", f"R{i % 3}", day + datetime.timedelta(days=i), float(i * 100), ["99213"], ["I10"], ["x"], "urgent pain")
        for i in range(6)
    ]
    schema = (
        "claim_id string, patient_id string, provider_id string, date_of_service date, billed_amount double, "
        "procedure_codes array<string>, diagnosis_codes array<string>, red_flags array<string>, notes string"
    )
    wide = features.feature_table(spark.createDataFrame(rows, schema).withColumn("billed_amount", F.col("billed_amount").cast("decimal(12,2)")))
    assert wide.count() == 6 and len(wide.columns) == len(set(wide.columns)) > 45
    first = wide.where("claim_id = 'C3'").first()
    assert first["provider_connections"] == 2 and first["contains_urgent"] == 1
    assert first["claim_sequence_position"] == 2 and first["days_between_patient_claims"] == 2


def test_service_hours_defaults(spark):
    out = features.service_hours(spark.createDataFrame([("a",)], "claim_id string")).first()
    assert (out["hour_of_service"], out["is_after_hours"], out["rendering_hours"], out["rendering_hours_log"]) == (12, 0, 1.0, 0.0)


# --- files and streams ----------------------------------------------------------------


@pytest.fixture()
def folder(tmp_path):
    def claim(i, **more):
        return {"claim_id": f"CLM-2024-{i}", "patient_id": "PAT-1", "billed_amount": 10.5, "date_of_service": "2024-01-02", **more}

    (tmp_path / "medical_a.json").write_text(json.dumps({"claims": [claim(1), claim(2)]}))
    (tmp_path / "pharmacy_b.json").write_text(json.dumps([claim(3), claim(4), claim(5)]))
    (tmp_path / "drug_pharmacy.json").write_text(json.dumps([claim(6, referring_provider="PRV-1", performing_provider="PRV-2")]))
    (tmp_path / "broken.json").write_text('{"claims": [')
    (tmp_path / "other.json").write_text(json.dumps({"something": 1}))
    deep = tmp_path / "deep"
    deep.mkdir()
    (deep / "medical_c.json").write_text(json.dumps([claim(7)]))
    return tmp_path


def ids(df):
    return sorted(int(r["claim_id"].split("-")[-1]) for r in df.select("claim_id").collect())


def test_claim_files(spark, folder):
    path = str(folder)
    assert ids(files.load_claims(spark, path)) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(files.load_claim_type(spark, path, "medical")) == [1, 2]
    assert ids(files.load_claim_type(spark, path, "pharmacy")) == [3, 4, 5, 6]
    assert ids(files.load_claims(spark, path, claim_types=["medical", "pharmacy"])) == [1, 2, 3, 4, 5, 6]
    assert files.load_claims(spark, path, max_file_mb=0.0001).count() == 0
    raw = files.read_claim_files(spark, path)
    assert files.quarantined(raw).count() == 1
    aliased = files.load_claims(spark, path).where("claim_id = 'CLM-2024-6'").first()
    assert (aliased["provider_id"], aliased["referred_to_provider"]) == ("PRV-1", "PRV-2")
    with pytest.raises(ValueError):
        files.load_claim_type(spark, path, "dental")


def test_inventory(spark, folder):
    by_type = {r["type"]: r["files"] for r in files.inventory_by_type(files.file_inventory(spark, str(folder))).collect()}
    assert by_type == {"medical": 2, "pharmacy": 2, "unknown": 2}
    stats = files.load_statistics(files.read_claim_files(spark, str(folder)), seconds=2.0).first()
    assert stats["claims_loaded"] == 7 and stats["read_errors"] == 1 and stats["claims_per_second"] == 3.5


def test_lists_in_csv(spark, tmp_path):
    lists = [["a|b", 'c"d'], [], None]
    rows = spark.createDataFrame([(i, codes) for i, codes in enumerate(lists)], "id int, codes array<string>")
    files.write_claims(rows, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert [r["codes"] and json.loads(r["codes"]) for r in back] == lists


def test_training_needs_its_label(spark):
    with pytest.raises(ValueError):
        files.read_training(spark, "nowhere.csv", T.StructType([T.StructField("x", T.DoubleType())]))


STREAM = "claim_id string, provider_id string, patient_id string, date_of_service date, submission_timestamp timestamp"


def stream_rows(n):
    day = datetime.date(2024, 1, 1)
    return [
        (f"C{i:03d}", f"PRV-{i % 2}", f"PAT-{i % 3}", day, datetime.datetime(2024, 1, 1, 0, i % 60)) for i in range(n)
    ]


def test_running_history_continues_over_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = stream_rows(12)
    for i in range(3):
        spark.createDataFrame(rows[i * 4 : i * 4 + 4], STREAM).coalesce(1).write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = streams.claim_stream(spark, source, schema, 1, "parquet")
    streams.score_against_history(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = {r["claim_id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(out) == 12
    # all claims share one day, so the counts run through all batches
    assert max(r["provider_today"] for r in out.values()) == 6
    assert max(r["patient_today"] for r in out.values()) == 4
    assert {r["recent_providers"] for r in out.values()} == {1, 2}


def test_running_history_keeps_its_bound_inside_a_batch(spark, tmp_path):
    day = datetime.date(2024, 1, 1)
    rows = [(f"C{i:03d}", "PRV-1", None if i % 50 == 0 else "PAT-1", None if i == 149 else day, None) for i in range(300)]
    found = []
    for batches in (1, 3):
        source, size = str(tmp_path / f"in{batches}"), 300 // batches
        for i in range(batches):
            spark.createDataFrame(rows[i * size : (i + 1) * size], STREAM).coalesce(1).write.mode("append").parquet(source)
        stream = streams.claim_stream(spark, source, spark.read.parquet(source).schema, 1, "parquet")
        streams.score_against_history(stream, str(tmp_path / f"out{batches}"), str(tmp_path / f"cp{batches}"))
        out = spark.read.parquet(str(tmp_path / f"out{batches}")).collect()
        assert max(r["provider_today"] for r in out) == 100
        assert max(r["patient_today"] for r in out if r["patient_today"] is not None) == 50
        assert next(r["provider_today"] for r in out if r["claim_id"] == "C149") == 0
        found.append(sorted(r["provider_today"] for r in out))
    assert len(found[0]) == len(found[1]) == 300


def test_repeated_claims_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = stream_rows(6)
    for part in (rows[:4], rows[2:]):
        spark.createDataFrame(part, STREAM).coalesce(1).write.mode("append").parquet(source)
    stream = streams.claim_stream(spark, source, spark.read.parquet(source).schema, 1, "parquet")
    streams.ingest(streams.without_repeats(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_late_and_repeated_claims(spark, tmp_path):
    """The watermark that passed a claim is that of two batches before it, as Spark has it for late rows."""
    schema = "claim_id string, submission_timestamp timestamp"

    def at(day):
        return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)

    parts = [
        [("a", at(0)), ("b", at(1)), ("n", None)], [("c", at(40)), ("a", at(0))], [("d", at(41)), ("c", at(40))],
        [("e", at(90)), ("x", at(2)), ("d", at(41)), ("y", at(33)), ("z", at(34))], [("x", at(2)), ("f", at(89))],
    ]
    source = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = streams.claim_stream(spark, source, spark.read.parquet(source).schema, 1, "parquet")
    accepted, late = str(tmp_path / "accepted"), str(tmp_path / "late")
    streams.accept_and_set_aside(stream, accepted, late, str(tmp_path / "marks"), str(tmp_path / "cp"))
    took = sorted(r["claim_id"] for r in spark.read.parquet(accepted).collect())
    aside = sorted(r["claim_id"] for r in spark.read.parquet(late).collect())
    assert took == ["a", "b", "c", "d", "e", "f", "n", "z"]
    assert aside == ["x", "x", "y"]


def test_state_grows_with_the_batch_only(spark, tmp_path):
    """A batch of one provider leaves the state of the others as it is."""
    source, day = str(tmp_path / "in"), datetime.date(2024, 1, 1)
    parts = [[(f"A{i:03d}", f"PRV-{i}", f"PAT-{i}", day, None) for i in range(40)], [("B1", "PRV-7", "PAT-7", day, None)], [("B2", "PRV-7", "PAT-9", day, None)]]
    for part in parts:
        spark.createDataFrame(part, STREAM).coalesce(1).write.mode("append").parquet(source)
    seen = []
    stream = streams.claim_stream(spark, source, spark.read.parquet(source).schema, 1, "parquet")
    streams.score_against_history(stream, str(tmp_path / "out"), str(tmp_path / "cp"), on_progress=seen.append)
    puts = [sum(s["customMetrics"]["rocksdbPutCount"] for s in p["stateOperators"]) for p in seen if p["numInputRows"]]
    assert len(puts) == 3 and puts[0] >= 80 and max(puts[1:]) < puts[0] / 2
    out = {r["claim_id"]: (r["provider_today"], r["patient_today"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["B1"] == (2, 2) and out["B2"] == (3, 2) and len(out) == 42


def test_keys_share_the_calls_to_the_state(spark, tmp_path):
    """Forty providers and patients in four buckets take eight values of state, and the counts stay those of each key."""
    source, day = str(tmp_path / "in"), datetime.date(2024, 1, 1)
    rows = [(f"C{i:03d}", None if i == 79 else f"PRV-{i % 40}", f"PAT-{i % 40}", day, None) for i in range(80)]
    spark.createDataFrame(rows, STREAM).coalesce(1).write.parquet(source)
    seen = []
    stream = streams.claim_stream(spark, source, spark.read.parquet(source).schema, 1, "parquet")
    streams.score_against_history(stream, str(tmp_path / "out"), str(tmp_path / "cp"), on_progress=seen.append, buckets=4)
    assert sum(s["customMetrics"]["rocksdbPutCount"] for p in seen for s in p["stateOperators"]) <= 8
    out = {r["claim_id"]: (r["provider_today"], r["patient_today"], r["recent_providers"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out["C000"] == (1, 1, 1) and out["C041"] == (2, 2, 1) and out["C079"] == (None, 2, 2) and len(out) == 80

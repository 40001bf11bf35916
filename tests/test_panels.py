"""Products dealt out in panels of blocks, and unions of sketches outside of Spark's own functions."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimscope.operators import blocks, graph, sketches

#: More than eight blocks of providers, so that a panel has several blocks and there are several panels.
PROVIDERS = 4700


@pytest.fixture(scope="module")
def claims(spark):
    draw = random.Random(5)
    names = [f"v{n:04}" for n in range(PROVIDERS)]
    draw.shuffle(names)
    # one hub beside whom 1200 lie, and short chains of the others
    rows = [(f"h{n}", v) for n in range(1, 1200) for v in (names[0], names[n])]
    for at in range(1200, PROVIDERS - 4, 4):
        rows += [(f"c{at}-{n}", names[at + n + k]) for n in range(3) for k in (0, 1)]
    return spark.createDataFrame(rows, "patient_id string, provider_id string")


def test_walks_over_several_panels(spark, claims):
    names = [r[0] for r in claims.select("provider_id").distinct().collect()]
    n = len(names)
    links = blocks.links_of_patients(graph.incidences(claims))
    assert links.nodes == n and blocks._panel(n, blocks.MOST_BITS) > 1 and n > 8 * blocks.SIDE
    row = links.blocks.first()
    assert zlib.decompress(row["packed"]) == row["bits"]
    found = {r[0]: r[1] for r in graph.closeness(claims).collect()}
    near = {}
    for group in claims.groupBy("patient_id").agg(F.collect_set("provider_id")).collect():
        for a in group[1]:
            near.setdefault(a, set()).update(b for b in group[1] if b != a)
    hub = max(near, key=lambda v: len(near[v]))

    def closeness(others, distance):
        return others / distance * others / (n - 1)

    for v in names:
        if v == hub:
            expected = closeness(1199, 1199)
        elif hub in near[v]:
            expected = closeness(1199, 1 + 2 * 1198)
        else:
            expected = closeness(3, 6 if len(near[v]) == 1 else 4)
        assert found[v] == pytest.approx(expected)
    providers = claims.select("provider_id").distinct()
    between = {r[0]: r[1] for r in graph.betweenness(graph.edges(claims), providers).collect()}
    scale = (n - 1) * (n - 2)
    for v in names:
        expected = 1199 * 1198 if v == hub else 0 if len(near[v]) == 1 else 4
        assert between[v] == pytest.approx(expected / scale)


def test_many_wedges_are_not_listed(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(f"p{p}", f"v{draw.randrange(300)}") for p in range(3000) for _ in range(3)]
    claims = spark.createDataFrame(rows, "patient_id string, provider_id string")
    providers = graph.incidences(claims).select("provider_id").distinct()
    listed = {r[0]: r[1] for r in graph.clustering(graph.edges(claims), providers).collect()}
    used = []
    multiply = graph.link_triangles
    monkeypatch.setattr(graph, "MOST_WEDGES", 0)
    monkeypatch.setattr(graph, "link_triangles", lambda links: used.append(1) or multiply(links))
    # some 14,000 wedges in one pair of blocks: fewer than were listed before
    few = claims.where("patient_id < 'p14'")
    providers = graph.incidences(few).select("provider_id").distinct()
    graph.clustering(graph.edges(few), providers).collect()
    assert used
    providers = graph.incidences(claims).select("provider_id").distinct()
    assert {r[0]: r[1] for r in graph.clustering(graph.edges(claims), providers).collect()} == pytest.approx(listed)


def test_united_sketches_are_those_of_spark(spark):
    names = F.concat(F.lit("v"), F.col("id").cast("string"))

    def sketch(start, end):
        return bytes(spark.range(start, end).agg(F.hll_sketch_agg(names, 12)).first()[0])

    large, other, small = sketch(0, 1500), sketch(1000, 2500), sketch(0, 100)
    both = spark.createDataFrame([(large, other)], "a binary, b binary").select(F.hll_union("a", "b")).first()[0]
    made = np.maximum(sketches.registers(large, 12), sketches.registers(other, 12))
    assert sketches.sketch_of_registers(made, 12) == bytes(both)
    hashes = sketches.hashes(small)
    assert len(hashes) == 100 and sketches.hashes(large) is None
    parts = spark.createDataFrame([(s,) for s in sketches.sketches_of_hashes(hashes, 12)], "s binary")
    assert parts.agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0] == 100


def test_sketches_turn_to_registers_on_the_way(spark):
    rows = [(f"p{p}", f"v{v}") for p in range(3) for v in range(p * 400, p * 400 + 500)]
    claims = spark.createDataFrame(rows, "patient_id string, provider_id string")
    exact = {r[0]: r[1] for r in graph.closeness(claims).collect()}
    found = {r["provider_id"]: r for r in graph.closeness_estimates(claims).collect()}
    assert set(found) == set(exact)
    for v, value in exact.items():
        assert found[v]["providers_reached"] == pytest.approx(1300, rel=0.06)
        assert found[v]["provider_closeness_centrality"] == pytest.approx(value, rel=0.12)

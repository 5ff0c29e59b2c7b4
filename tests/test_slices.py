"""Steps over large tables: shuffle files go behind each, slices change no result, and pools are made for what is asked."""

import time

from pyspark.sql import functions as F

from tripleguard import session
from tripleguard.operators import graph
from tripleguard.queries.graph import QUERIES

K = 3
#: A hub of 12 edges, entities of K edges and fewer, a self loop, two relations of a pair.
EDGES = [(i, 0, i % 2, 20 + i) for i in range(12)] + [(12, 5, 0, 5), (13, 6, 1, 7), (14, 6, 0, 8), (15, 6, 1, 9), (16, 7, 0, 8), (17, 7, 1, 8)]


def _edges(spark):
    return spark.createDataFrame(EDGES, "pos long, h long, r long, t long")


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_") and name.endswith(".data")}


def test_shuffle_files_go_behind_a_step(spark):
    before = _shuffle_files(spark)
    found = session.materialised(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(50):  # they go in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and found.count() == 100
    assert spark.conf.get(session.CLEAN_UP) == "false"


def _pools(triples, **more):
    return {r["e"]: (r["degree"], [tuple(x) for x in r["near"]]) for r in graph.pools(triples, K, "1", **more).collect()}


def test_slices_and_hubs_change_no_pool(spark, monkeypatch):
    whole = _pools(_edges(spark))
    monkeypatch.setattr(graph, "LARGE", 4)
    assert _pools(_edges(spark)) == whole and whole[0][0] == 12
    monkeypatch.setattr(session, "STEP", 10)
    assert _pools(_edges(spark)) == whole
    assert _pools(_edges(spark), above=2) == {e: x for e, x in whole.items() if x[0] > 2}


def test_pools_are_made_for_what_is_wanted(spark):
    wanted = spark.createDataFrame([(0, True), (8, False), (77, True)], "e long, heads boolean")
    found = graph.pools(_edges(spark), K, "1", wanted=wanted)
    assert {(r["e"], r["heads"]) for r in found.collect()} == {(0, True), (8, False)}
    whole = _pools(_edges(spark))
    assert _pools(_edges(spark), wanted=wanted) == {e: whole[e] for e in (0, 8)}


def test_sample_meets_pools_of_its_own_ends(spark, monkeypatch):
    asked, old = [], graph.pools
    monkeypatch.setattr(graph, "pools", lambda *a, **b: asked.append(old(*a, **b)) or asked[-1])
    got = graph.triple_neighbourhood(_edges(spark).where("pos = 13"), _edges(spark), K, "1")
    assert got.count() == 2 * K + 2
    assert {r["e"] for r in asked[0].collect()} == {6, 7}


def test_star_queries_in_slices(spark, monkeypatch):
    names = ("star_neighborhood", "star_hub_sample")
    rows = lambda: [sorted(map(tuple, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in names]
    whole = rows()
    monkeypatch.setattr(session, "STEP", 5_000)
    monkeypatch.setattr(graph, "LARGE", 50)
    assert rows() == whole and all(whole)

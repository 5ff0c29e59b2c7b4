"""Neighbourhoods are unfolded behind their joins, not shuffled."""

import re

import pytest

from tripleguard.operators import encoder, graph

K = 3
#: A hub of 12 edges, entities of K edges and fewer, a self loop, a fact read with two relations; 90 and 91 have no edges.
FACTS = [(0, i, i % 2, 20 + i) for i in range(12)] + [(1, 5, 0, 5), (2, 6, 1, 7), (3, 6, 0, 8), (4, 6, 1, 9), (5, 7, 0, 8), (6, 7, 1, 8)]
EDGES = [(i, 0 if i < 12 else h, r, t) for i, (_, h, r, t) in enumerate(FACTS)]
ROWS = [*EDGES, (100, 90, 0, 91), (101, 0, 1, 90)]


@pytest.fixture
def tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "pos long, h long, r long, t long")
    return make(ROWS), make(EDGES)


def test_no_neighbour_goes_through_a_shuffle(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = graph.triple_neighbourhood(*tables, K, "1")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [(len(re.match(r"[\s:|+-]*", x)[0]), x) for x in plan.splitlines()]
    assert any("Generate" in x for _, x in lines)
    for i, (depth, x) in enumerate(lines):
        below = []
        for d, y in lines[i + 1 :]:
            if d <= depth:
                break
            below.append(y)
        assert "Exchange" not in x or not any("Generate" in y for y in below)


def test_pools_hold_what_numbers_say(tables):
    edges = graph.numbered_neighbours(tables[1], "1").where(f"i < {K}").collect()
    want = {(r["e"], r["i"]): (r["h"], r["r"], r["t"], r["degree"]) for r in edges}
    got = {(r["e"], i): (*x, r["degree"]) for r in graph.pools(tables[1], K, "1").collect() for i, x in enumerate(r["near"])}
    assert got == want and len(got) > 20


def test_rows_attend_as_their_unfolded_neighbourhoods_do(spark, tables):
    rows, triples = tables
    weights = encoder.initial_weights(4, 2, 3)
    ids = lambda n, kind: encoder.initial_vectors(spark.range(n), 4, kind, "1")
    ent, rel = ids(100, "ent"), ids(2, "rel")
    around = graph.triple_neighbourhood(rows, triples, K, "1")
    want = {r["pos"]: r for r in encoder.attend(around, encoder.encode_triples(around, ent, rel, weights), weights).collect()}
    got = {r["pos"]: r for r in encoder.attend_rows(rows, triples, ent, rel, weights, K, "1").collect()}
    assert got.keys() == want.keys() == {r[0] for r in ROWS}
    for pos, r in got.items():
        assert tuple(r) == pytest.approx(tuple(want[pos]), abs=1e-9)

"""Rows meet pools once, in slices and with hubs dealt out, and give what unfolded neighbourhoods give."""

import numpy as np
import pytest

from tripleguard import session
from tripleguard.operators import encoder, graph

K = 3
EDGES = [(i, 0, i % 2, 20 + i) for i in range(12)] + [(12, 5, 0, 5), (13, 6, 1, 7), (14, 6, 0, 8), (15, 6, 1, 9), (16, 7, 0, 8), (17, 7, 1, 8), (18, 40, 0, 20), (19, 41, 1, 20), (20, 42, 1, 20)]
#: 90 and 91 have no edges.
ROWS = [*EDGES, *((100 + i, 0, 1, 90) for i in range(20)), (130, 90, 0, 91), (131, 90, 1, 0)]


def test_slices_and_hubs_attend_as_unfolded_neighbourhoods_do(spark, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "pos long, h long, r long, t long")
    rows, triples = make(ROWS), make(EDGES)
    weights = encoder.initial_weights(4, 2, 3)
    ids = lambda n, kind: encoder.initial_vectors(spark.range(n), 4, kind, "1")
    ent, rel = ids(100, "ent"), ids(2, "rel")
    around = graph.triple_neighbourhood(rows, triples, K, "1")
    want = {r["pos"]: r for r in encoder.attend(around, encoder.encode_triples(around, ent, rel, weights), weights).collect()}
    monkeypatch.setattr(graph, "LARGE", 4)
    monkeypatch.setattr(session, "STEP", 10)
    monkeypatch.setattr(encoder, "WIDE", 15)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # an entity goes on in the next batch
    try:
        got = {r["pos"]: r for r in encoder.attend_rows(rows, triples, ent, rel, weights, K, "1").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() == {r[0] for r in ROWS}
    for pos, r in got.items():
        assert tuple(r) == pytest.approx(tuple(want[pos]), abs=1e-9)


def test_a_pool_is_attended_as_its_picked_rows_are():
    rng, weights = np.random.default_rng(1), encoder.initial_weights(4, 2, 3)
    w = weights["att_b.w"]
    own, pool, picks = rng.normal(size=(7, 2)), rng.normal(size=(5, 2)), rng.integers(0, 5, (7, 9))
    unfolded = np.concatenate([own[:, None], pool[picks]], axis=1)
    assert encoder.attend_pool(own @ w, pool @ w, picks, 9, weights, "att_b", 0.2, 0.001) == pytest.approx(encoder.attention(unfolded, weights, "att_b", 0.2, 0.001))
    every = np.concatenate([own[:, None], np.broadcast_to(pool, (7, 5, 2))], axis=1)
    assert encoder.attend_pool(own @ w, pool @ w, None, 5, weights, "att_b", 0.2, 0.001) == pytest.approx(encoder.attention(every, weights, "att_b", 0.2, 0.001))
    alone = np.repeat(own[:, None], 10, axis=1)
    assert encoder.attend_pool(own @ w, None, None, 9, weights, "att_b", 0.2, 0.001) == pytest.approx(encoder.attention(alone, weights, "att_b", 0.2, 0.001))


def test_no_pool_stands_in_a_row_of_the_join(spark, monkeypatch):
    """A pool goes to Python once for each entity, part and side, not once for each row."""
    seen, old = [], encoder.in_slices
    monkeypatch.setattr(encoder, "in_slices", lambda n, make, step: seen.append(make(lambda df, *keys: df)) or old(n, make, step))
    make = lambda rows: spark.createDataFrame(rows, "pos long, h long, r long, t long")
    ids = lambda n, kind: encoder.initial_vectors(spark.range(n), 4, kind, "1")
    encoder.attend_rows(make(ROWS), make(EDGES), ids(100, "ent"), ids(2, "rel"), encoder.initial_weights(4, 2, 3), K, "1")
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("near_a" in x for x in plan.splitlines() if "Join" in x)

"""A training step moves a vector once for each row that needs it, and puts none in a list."""

import pytest
from pyspark.sql import functions as F

from tripleguard.plans import optimiser

PAIRS = "pos long, h long, r long, t long, h2 long, r2 long, t2 long"
#: One slot replaced (each of the three), nothing replaced, everything replaced, a loop.
ROWS = [(0, 1, 0, 2, 3, 0, 2), (1, 1, 0, 2, 1, 1, 2), (2, 1, 0, 2, 1, 0, 3), (3, 1, 0, 2, 1, 0, 2), (4, 1, 0, 2, 2, 1, 3), (5, 1, 0, 1, 1, 0, 3)]


def test_shared_slots_of_a_pair_are_one_row(spark):
    found = optimiser._members(spark.createDataFrame(ROWS, PAIRS), ["pos"])
    assert {r["pos"]: r["count"] for r in found.groupBy("pos").count().collect()} == {0: 4, 1: 4, 2: 4, 3: 3, 4: 6, 5: 4}
    signs = found.groupBy("pos").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    assert all((r["a"], r["b"]) == (1.0, 1.0) for r in signs)


def test_no_vectors_are_gathered_in_lists(spark):
    state = optimiser.initial_state(spark.range(4), spark.range(2), 3, "1")
    found = optimiser.gradients(spark.createDataFrame(ROWS, PAIRS), state, 3, 0.5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_scores_are_distances(spark):
    state = optimiser.initial_state(spark.range(4), spark.range(2), 3, "1")
    x = {(r["kind"], r["id"]): r["x"] for r in state.collect()}
    got = {r["pos"]: r["score"] for r in optimiser.distances(spark.createDataFrame(ROWS, PAIRS), state).collect()}
    for pos, h, r, t, *_ in ROWS:
        assert got[pos] == pytest.approx(sum((a + b - c) ** 2 for a, b, c in zip(x["e", h], x["r", r], x["e", t])) ** 0.5)
    assert optimiser.distances(spark.createDataFrame(ROWS, PAIRS), state.limit(0)).count() == 0

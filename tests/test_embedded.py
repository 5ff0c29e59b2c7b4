"""Tensors of batches: no row carries vectors through a shuffle, and they hold what their rows say."""

import re

import pytest

from tripleguard.operators import graph

#: 3 has no vector, 9 neither as a relation; batches 0 and 1, and 2 that has no row with all vectors.
ROWS = [(0, 0, 0, 1, 0, 2), (0, 0, 1, 2, 1, 1), (0, 1, 0, 3, 0, 1), (1, 2, 0, 2, 0, 2), (1, 2, 1, 1, 9, 1), (2, 3, 0, 3, 0, 3)]


@pytest.fixture
def made(spark):
    batch = spark.createDataFrame(ROWS[::-1], "batch_id long, pos long, slot int, h long, r long, t long")
    vectors = lambda rows: spark.createDataFrame(rows, "id long, vector array<float>")
    return graph.embedded_batches(batch, vectors([(2, [2.0, 2.5]), (1, [1.0, 1.5]), (7, [7.0, 7.5])]), vectors([(1, [-1.0, -1.5]), (0, [0.25, 0.5])]))


def test_tensors_hold_the_vectors_of_their_rows(made):
    got = {r["batch_id"]: (r["n"], r["tensor"]) for r in made.collect()}
    assert got == {0: (2, [1.0, 1.5, 0.25, 0.5, 2.0, 2.5, 2.0, 2.5, -1.0, -1.5, 1.0, 1.5]), 1: (1, [2.0, 2.5, 0.25, 0.5, 2.0, 2.5])}


def test_a_batch_meets_each_vector_once(made):
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, \(.*", plan)
    assert joins and not any(re.search(r"\b[hrt]#", x) for x in joins)

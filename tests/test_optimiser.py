"""Training on parameter tables: finite differences, a plain Adam, falling losses, and going on after a stop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleguard.plans import optimiser
from tripleguard.session import exists

DIM = 5


def graph(spark, n=60):
    rng = random.Random(4)
    rows = [(i, 0 if i % 3 else rng.randrange(9), i % 2, rng.randrange(9), 0 if i % 3 else rng.randrange(9), i % 2, rng.randrange(9)) for i in range(n)]
    rows.append((n, 1, 0, 2, None, None, None))
    pairs = spark.createDataFrame(rows, "pos long, h long, r long, t long, h2 long, r2 long, t2 long").repartition(4)
    ids = lambda k: spark.range(k)
    return rows[:-1], pairs, optimiser.initial_state(ids(9), ids(2), DIM, "1")


def arrays(state, column="x"):
    return {(r["kind"], r["id"]): np.array(r[column]) for r in state.collect()}


def plain_loss(rows, x, gamma):
    total = 0.0
    for _, h, r, t, h2, r2, t2 in rows:
        s = np.linalg.norm(x["e", h] + x["r", r] - x["e", t])
        s2 = np.linalg.norm(x["e", h2] + x["r", r2] - x["e", t2])
        total += max(0.0, s - s2 + gamma)
    return total


def test_the_gradient_equals_finite_differences(spark):
    rows, pairs, state = graph(spark)
    found = {(r["kind"], r["id"]): r for r in optimiser.gradients(pairs.where("h2 is not null"), state, DIM, 0.5).collect()}
    x = arrays(state)
    assert sum(r["n"] for r in found.values()) == len(rows)
    assert sum(r["loss"] for r in found.values()) == pytest.approx(plain_loss(rows, x, 0.5))
    for key, vector in x.items():
        for i in range(DIM):
            step = np.zeros(DIM)
            step[i] = 1e-6
            up, down = ({**x, key: vector + s * step} for s in (1, -1))
            slope = (plain_loss(rows, up, 0.5) - plain_loss(rows, down, 0.5)) / 2e-6
            assert (found[key]["g"][i] if key in found else 0.0) == pytest.approx(slope, abs=1e-5), (key, i)


def test_a_distance_of_nothing_has_no_gradient(spark):
    zero = [0.0] * DIM
    state = optimiser.given_state(*(spark.createDataFrame([(i, zero) for i in range(n)], "id long, vector array<double>") for n in (3, 1)))
    pairs = spark.createDataFrame([(0, 0, 0, 1, 2, 0, 1)], "pos long, h long, r long, t long, h2 long, r2 long, t2 long")
    assert all(v == 0 for r in optimiser.gradients(pairs, state, DIM, 0.5).collect() for v in r["g"])


def test_steps_equal_a_plain_adam(spark):
    rows, pairs, state = graph(spark)
    x = arrays(state)
    m, v = ({k: np.zeros(DIM) for k in x} for _ in range(2))
    pairs = pairs.where("h2 is not null")
    for step in (1, 2, 3):
        gradient = optimiser.gradients(pairs, state, DIM, 0.5)
        g = {k: a / len(rows) for k, a in arrays(gradient, "g").items()}
        state = spark.createDataFrame(optimiser.adam(state, gradient, len(rows), step, 0.05).collect(), state.schema)
        for k in x:
            d = g.get(k, np.zeros(DIM))
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            x[k] = x[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        for k, a in arrays(state).items():
            assert a == pytest.approx(x[k], abs=1e-9)


def test_training_goes_on_after_a_stop_and_the_loss_falls(spark, tmp_path):
    _, pairs, start = graph(spark)
    told = []
    whole = optimiser.train(pairs, start, f"{tmp_path}/a", 4, DIM, 32, "1", rate=0.1, told=lambda *x: told.append(x))
    losses = [r["loss"] for r in optimiser.read_losses(spark, f"{tmp_path}/a").orderBy("epoch").collect()]
    assert losses == [x[1] for x in told] and losses[0] > losses[-1] and len(losses) == 4
    optimiser.train(pairs, start, f"{tmp_path}/b", 2, DIM, 32, "1", rate=0.1)
    # a state of the third epoch whose loss was never written doesn't count
    optimiser.read_state(spark, f"{tmp_path}/b", 1).write.parquet(f"{tmp_path}/b/state-3")
    resumed = optimiser.train(pairs, start, f"{tmp_path}/b", 4, DIM, 32, "1", rate=0.1, keep=2)
    assert not exists(spark, f"{tmp_path}/b/state-1") and exists(spark, f"{tmp_path}/b/state-3")
    for column in ("x", "m", "v"):
        a, b = arrays(whole, column), arrays(resumed, column)
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    assert [r["loss"] for r in optimiser.read_losses(spark, f"{tmp_path}/b").orderBy("epoch").collect()] == pytest.approx(losses)
    again = optimiser.train(pairs, start, f"{tmp_path}/b", 4, DIM, 32, "1", rate=0.1)  # nothing left to do
    assert arrays(again)["e", 0] == pytest.approx(arrays(whole)["e", 0], abs=1e-12)


def test_trained_distances_tell_facts_from_others(spark, tmp_path):
    facts = [(i, i, 0, (i + 1) % 12) for i in range(12)]
    rows = spark.createDataFrame(facts, "pos long, h long, r long, t long")
    pairs = rows.select("*", F.col("h").alias("h2"), F.col("r").alias("r2"), ((F.col("t") + 5) % 12).alias("t2"))
    start = optimiser.initial_state(spark.range(12), spark.range(1), DIM, "2")
    state = optimiser.train(pairs, start, f"{tmp_path}/s", 12, DIM, 12, "2", rate=0.2, gamma=1.0)
    mean = lambda t: optimiser.distances(t, state).agg(F.avg("score")).first()[0]
    assert mean(rows) + 0.5 < mean(pairs.select("pos", "h", "r", F.col("t2").alias("t")))


def test_no_pairs_leave_the_vectors(spark, tmp_path):
    _, pairs, start = graph(spark)
    state = optimiser.train(pairs.limit(0), start, f"{tmp_path}/n", 1, DIM, 32, "1")
    assert arrays(state)["e", 3] == pytest.approx(arrays(start)["e", 3]) and optimiser.read_losses(spark, f"{tmp_path}/n").first()["loss"] is None

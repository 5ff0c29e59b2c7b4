"""Known facts are grouped and ordered once for several replacements; values of few relations are bits."""

import random

import pytest
from pyspark.sql import functions as F

from tripleguard.operators import corrupt, scan
from tripleguard.queries import graph


@pytest.mark.parametrize("long", [3, 2_000])
@pytest.mark.parametrize("bits", [0, 64])
def test_shared_facts_give_the_same_values(spark, monkeypatch, long, bits):
    monkeypatch.setattr(scan, "LONG", long)
    monkeypatch.setattr(scan, "BITS", bits)
    rng = random.Random(3)
    facts = {(rng.randrange(6), rng.randrange(4), rng.randrange(6)) for _ in range(110)} | {(0, r, 1) for r in range(4)}
    known = spark.createDataFrame([*facts, *facts], "h long, r long, t long").repartition(3)
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(sorted(facts))], "pos long, h long, r long, t long")
    kept = corrupt.taken_values(known, 6, 4, keep=True)
    for slots in (("h", "r", "t"), ("h", "t"), ("r",)):
        made = {r["pos"]: tuple(r) for r in corrupt.single_slot(rows, kept, 6, 4, "1", slots).collect()}
        assert made == {r["pos"]: tuple(r) for r in corrupt.single_slot(rows, known, 6, 4, "1", slots).collect()}
        drawn = {r["pos"]: r["k"] for r in rows.select("pos", corrupt.draw("1", "free", F.col("pos")).alias("k")).collect()}
        assert len(made) == len(facts)
        for pos, slot, *got in made.values():
            own, i = list(sorted(facts)[pos]), "hrt".index(slot)
            free = [u for u in range(4 if slot == "r" else 6) if (*own[:i], u, *own[i + 1 :]) not in facts]
            if free:
                own[i] = free[drawn[pos] % len(free)]
            assert got == (own if free else [None] * 3)


def test_all_64_bits(spark):
    taken = spark.createDataFrame([("a", u) for u in range(64) if u not in (0, 40)] + [("b", u) for u in range(63)] + [("c", u) for u in range(64)], "g string, u long")
    asks = spark.createDataFrame([(g, k) for g in "abcd" for k in (0, 1, None)], "g string, k long")
    found = {(r["g"], r["k"]): r["free"] for r in scan.nth_in_bits(asks, scan.as_bits(taken, ["g"]), ["g"], 64).collect()}
    assert found == {("a", 0): 0, ("a", 1): 40, ("b", 0): 63, ("b", 1): None, ("c", 0): None, ("c", 1): None, ("d", 0): 0, ("d", 1): 1} | {(g, None): None for g in "abcd"}


@pytest.mark.parametrize("name", ["baseline_test_batches", "train_pairs", "null_replace"])
def test_facts_are_grouped_once(spark, monkeypatch, name):
    grouped, held = [], scan.held
    monkeypatch.setattr(scan, "held", lambda *x: grouped.append(x) or held(*x))
    assert graph.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert len(grouped) == 1

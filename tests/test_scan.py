"""Running sums in groups, free numbers by rank, first rows, and what is built on them, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tripleguard.operators import corrupt, graph, scan, vocabulary
from tripleguard.plans import ranking
from tripleguard.sources import negatives


def test_running_sums_in_groups_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else f"g{rng.randrange(9)}", rng.randrange(5)) for i in range(800)]
    for parts in ("1", "5", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            df = spark.createDataFrame(rows, "i long, g string, x long").repartition(7)
            got = {r["i"]: r["upto"] for r in scan.running_in_groups(df, ["g"], ["i"], "x").collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        sums, want = Counter(), {}
        for i, g, x in rows:
            sums[g] += x
            want[i] = sums[g]
        assert got == want


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)"])
def test_nth_free_numbers(spark, kind):
    rng = random.Random(2)
    base = 10**25 if kind != "long" else 0
    taken = {("a", u) for u in rng.sample(range(60), 40)} | {("b", u) for u in range(10)} | {("c", 5)}
    held = spark.createDataFrame([(g, str(u)) for g, u in taken], "g string, u string").withColumn("u", F.col("u").cast(kind))
    asks = [(i, rng.choice("abcd"), rng.randrange(30)) for i in range(300)] + [(900, "d", base)]
    found = scan.nth_free(spark.createDataFrame([(i, g, str(k)) for i, g, k in asks], "pos long, g string, k string").withColumn("k", F.col("k").cast(kind)), held, ["g"])
    got = {r["pos"]: int(r["free"]) for r in found.collect()}
    free = {g: [u for u in range(200) if (g, u) not in taken] for g in "abcd"}
    assert got == {i: free[g][k] if k < 100 else k for i, g, k in asks}


def plain_order(value, down):
    kind = 0 if value is None else 2 if value != value else 1
    return (-kind, -value if kind == 1 else 0) if down else (kind, value if kind == 1 else 0)


@pytest.mark.parametrize("edge", [4, 1024])
@pytest.mark.parametrize("down", [False, True])
@pytest.mark.parametrize("shape", ["uniform", "ties", "wild", "odd"])
def test_first_rows_equal_a_sort(spark, monkeypatch, edge, down, shape):
    rng = random.Random(f"{edge}{down}{shape}")
    monkeypatch.setattr(scan, "EDGE", edge)
    make = {"uniform": lambda: rng.random(), "ties": lambda: float(rng.randrange(3)), "wild": lambda: rng.choice([1e300, -1e300, 1e-300, float("inf"), float("-inf"), 0.0, rng.gauss(0, 1)]), "odd": lambda: rng.choice([None, float("nan"), rng.random(), 7.0])}
    rows = [(i, make[shape]()) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(6)
    want = sorted(rows, key=lambda r: (plain_order(r[1], down), r[0]))
    for n in (0, 1, 2, 37, 749, 1499, 1500, 2000):
        got = scan.first_rows(df, [(F.col("x"), down), (F.col("id"), False)], n)
        assert sorted(r["id"] for r in got.collect()) == sorted(i for i, _ in want[:n]), n


def test_first_rows_have_no_limit_in_their_plan(spark):
    df = spark.range(5000).select("id", (F.col("id") % 17).alias("score"), F.lit(1).alias("label"))
    plan = scan.first_rows(df, [(F.col("score"), True), (F.col("id"), False)], 2500)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "Exchange" not in plan and "TakeOrdered" not in plan
    assert ranking.top_k(df, 3).select("id").collect()[0]["id"] == 16


def test_top_k_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 5.0, 0), (1, 5.0, 0), (2, 5.0, 1), (3, 9.0, 1)], "id long, score double, label int")
    assert sorted((r["rk"], r["id"]) for r in ranking.top_k(rows, 2).collect()) == [(1, 3), (2, 1)]


def hub_graph(spark):
    """One head with most facts, few relations, some ends that are seen once."""
    rng = random.Random(3)
    facts = {(0, rng.randrange(2), rng.randrange(40)) for _ in range(90)} | {(rng.randrange(40), rng.randrange(4), rng.randrange(40)) for _ in range(60)} | {(50, 5, 51)}
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(sorted(facts))], "pos long, h long, r long, t long")
    return facts, rows


def test_single_slots_are_free_and_spread_over_all_values(spark):
    facts, rows = hub_graph(spark)
    seen = defaultdict(set)
    for seed in range(6):
        made = corrupt.single_slot(rows, rows, 52, 6, str(seed)).join(rows.select("pos", F.col("h").alias("a"), F.col("r").alias("b"), F.col("t").alias("c")), "pos").collect()
        assert len(made) == len(facts)
        for m in made:
            new, old = (m["h"], m["r"], m["t"]), (m["a"], m["b"], m["c"])
            assert new not in facts and [x for x, y, z in zip("hrt", new, old) if y != z] == [m["slot"]]
            assert 0 <= new[0] < 52 and 0 <= new[1] < 6 and 0 <= new[2] < 52
            seen[m["slot"]].add(new["hrt".index(m["slot"])])
    assert len(seen["r"]) == 6 and len(seen["h"]) > 40 and len(seen["t"]) > 40


def test_random_triples_fill_what_is_free(spark):
    everything = [(h, r, t) for h in range(4) for r in range(2) for t in range(4)]
    known = spark.createDataFrame(everything[:-3], "h long, r long, t long")
    got = corrupt.fully_random(60, known, 4, 2, "1").collect()
    assert sorted(r["pos"] for r in got) == list(range(60)) and {(r["h"], r["r"], r["t"]) for r in got} == set(everything[-3:])
    many = corrupt.fully_random(50, known, 10**9, 10**5, "1").collect()  # more triples than 63 bits count
    assert len(many) == 50 and max(r["h"] for r in many) > 10**8 and all(0 <= r["t"] < 10**9 and 0 <= r["r"] < 10**5 for r in many)


def test_generated_negatives_keep_the_masks(spark):
    facts, rows = hub_graph(spark)
    heads, tails = defaultdict(set), defaultdict(set)
    for h, r, t in facts:
        heads[r].add(h)
        tails[r].add(t)
    planted = spark.createDataFrame([(1000, 1, 0, 0), (1001, 45, 5, 46)], rows.schema)  # no facts: one inside its pools, one outside
    asked = {r["pos"]: (r["h"], r["r"], r["t"]) for r in rows.unionByName(planted).collect()}
    allowed = {}
    for pos, (h, r, t) in asked.items():
        both = {(x, r, t) for x in heads[r]} | {(h, r, x) for x in tails[r]}
        allowed[pos] = both - facts - set(asked.values())
    seen = defaultdict(set)
    for seed in range(5):
        made = {m["pos"]: m for m in negatives.type_pool_negatives(rows.unionByName(planted), rows, str(seed)).collect()}
        assert made.keys() == asked.keys()  # one for one
        for pos, m in made.items():
            new = (m["h"], m["r"], m["t"])
            if not allowed[pos]:
                assert new == (None, None, None) and m["slot"] is None
            else:
                assert new in allowed[pos] and m["slot"] == ("h" if new[0] != asked[pos][0] else "t")
                seen[pos].add(new)
    assert allowed[[p for p, f in asked.items() if f == (50, 5, 51)][0]] == set()
    assert len(set().union(*seen.values())) > len(asked)


def test_generated_negatives_pass_through_another_vocabulary(spark):
    """Ids of a detector lie 1000 above those of the generator; what comes back is in the detector's ids."""
    facts, rows = hub_graph(spark)
    names = lambda cs, n: rows.select(F.explode(F.array(*cs)).alias("id")).distinct().select("id", F.concat(F.lit(n), "id").alias("name"))
    ent, rel = names("ht", "e"), names("r", "r")
    above = lambda v: v.withColumn("id", F.col("id") + 1000)
    mine = vocabulary.encode(vocabulary.decode(rows, ent, rel), above(ent), above(rel))
    inner = vocabulary.encode(vocabulary.decode(mine, above(ent), above(rel)), ent, rel)
    made = negatives.type_pool_negatives(inner, inner, "1").where("slot is not null")
    back = vocabulary.encode(vocabulary.decode(made.select("pos", "h", "r", "t"), ent, rel), above(ent), above(rel)).collect()
    assert len(back) == made.count() > 100
    assert all((r["h"] - 1000, r["r"] - 1000, r["t"] - 1000) not in facts and min(r["h"], r["r"], r["t"]) >= 1000 for r in back)


def test_draws_with_replacement_do_not_depend_on_partitions(spark):
    pairs = spark.range(50).select((F.col("id") * 3).alias("pos"), F.col("id").alias("h"))
    one = sorted(map(tuple, graph.pairs_with_replacement(pairs.repartition(1), 400, "1", 2).collect()))
    assert one == sorted(map(tuple, graph.pairs_with_replacement(pairs.repartition(9), 400, "1", 2).collect()))
    assert len(one) == 400 and max(Counter(r[1] for r in one).values()) > 1 and len({r[1] for r in one}) > 40
    other = sorted(map(tuple, graph.pairs_with_replacement(pairs, 400, "1", 3).collect()))
    assert other != one
    assert graph.pairs_with_replacement(pairs.limit(0), 5, "1").count() == 0


def test_batches_differ_from_epoch_to_epoch(spark):
    rows = spark.range(100).withColumnRenamed("id", "pos")
    by_epoch = [{r["pos"]: r["batch_id"] for r in corrupt.batches(rows, 32, "1", e).collect()} for e in (0, 1, 0)]
    assert by_epoch[0] == by_epoch[2] != by_epoch[1] and Counter(by_epoch[1].values()) == {0: 32, 1: 32, 2: 32, 3: 4}
    assert [corrupt.iterations(n, 32) for n in (0, 1, 32, 33, 100)] == [0, 1, 1, 2, 4]

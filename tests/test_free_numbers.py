"""Free numbers by rank in small and large groups, what they cost in shuffles, and the star graph's positions."""

import random

import pytest
from pyspark.sql import functions as F

from tripleguard.operators import corrupt, scan
from tripleguard.sources import star


@pytest.mark.parametrize("long", [3, 2_000])
def test_repeats_count_once_and_ranks_may_depend_on_what_is_taken(spark, monkeypatch, long):
    monkeypatch.setattr(scan, "LONG", long)
    rng = random.Random(5)
    taken = {(g, rng.randrange(60)) for g in "abc" for _ in range(40)} | {("d", 7)}
    held = spark.createDataFrame([*taken, *taken], "g string, u long").repartition(5)
    asks = [(i, rng.choice("abcde")) for i in range(300)]
    found = scan.nth_free(spark.createDataFrame(asks, "pos long, g string"), held, ["g"], lambda n: F.when(F.col("pos") % 7 > 0, F.col("pos") % (60 - n)))
    free = {g: [u for u in range(60) if (g, u) not in taken] for g in "abcde"}
    assert {r["pos"]: (r["g"], r["free"]) for r in found.collect()} == {i: (g, free[g][i % len(free[g])] if i % 7 else None) for i, g in asks}


def records(spark) -> dict[int, int]:
    """Rows that each stage so far has shuffled or written."""
    gateway, lists = spark.sparkContext._gateway, spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, gateway.new_array(spark._jvm.double, 0), lists())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size())}


def test_known_facts_are_seldom_moved(spark):
    """Random triples: known facts are made distinct, put in order, written and merged. One slot: they are grouped, for each of three slots."""
    n = 20_000
    known = spark.range(n).select((F.col("id") % 997).alias("h"), (F.col("id") % 3).alias("r"), F.col("id").alias("t")).repartition(8)
    rows = known.limit(50).withColumn("pos", F.monotonically_increasing_id()).select("pos", "h", "r", "t")
    for make, most in ((lambda: corrupt.fully_random(50, known, n, 3, "1"), 4.2), (lambda: corrupt.single_slot(rows, known, n, 3, "1"), 5.5)):
        before = set(records(spark))
        assert make().count() == 50
        assert sum(m for stage, m in records(spark).items() if stage not in before) < most * n


def test_star_positions_follow_kind_key_and_names(spark, tmp_path):
    """Equal keys are told apart by the names of their ends, as texts; null ends are left out."""
    tables = {
        "orders": ("o_orderkey long, o_custkey long", [(2, 9), (1, 10), (1, 9), (3, None)]), "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", [(1, 2, 5, 6), (1, 1, 7, 8)]),
        "customer": ("c_custkey long, c_nationkey long", [(9, 0)]), "supplier": ("s_suppkey long, s_nationkey long", [(6, 0)]), "nation": ("n_nationkey long, n_regionkey long", [(0, 1)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = star.star_graph(spark, str(tmp_path))
    got = [tuple(r) for r in found.orderBy("pos").collect()]
    want = [("c10", "placed", "o1"), ("c9", "placed", "o1"), ("c9", "placed", "o2"), ("o1", "contains", "p7"), ("o1", "contains", "p5"), ("o1", "shipped_by", "s8"), ("o1", "shipped_by", "s6"), ("c9", "in", "n0"), ("s6", "in", "n0"), ("n0", "in", "g1")]
    assert got == [(i, *f) for i, f in enumerate(want)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "order#" not in plan  # numbers are sorted and kept, not structs of texts

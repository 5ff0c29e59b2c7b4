"""Every registered graph query against its SQL, and hand-computed cases on small graphs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tripleguard.functions.draws import draw
from tripleguard.operators import corrupt, graph, vocabulary
from tripleguard.plans import experiments, ranking
from tripleguard.queries.graph import ORACLE_SQL, QUERIES
from tripleguard.sources import records, triples

SF = "/root/testdata/sf0.001"


def plain(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("events", "documents", "labels", "embeddings", "part", "orders", "lineitem", "customer", "supplier", "nation"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in rows)


def toy(spark):
    rows = [("Alice", "born_in", "Australia"), ("Alice", "married_to", "Bob"), ("Bob", "married_to", "Alice"), ("Alice", "lives_in", "Australia"), ("Carol", "born_in", "Japan"), ("Carol", "born_in", "Carol")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, h string, r string, t string")


def test_ids_follow_reading_order(spark):
    ids = {r["name"]: r["id"] for r in vocabulary.entity_vocabulary(toy(spark)).collect()}
    assert ids == {"Alice": 0, "Australia": 1, "Bob": 2, "Carol": 3, "Japan": 4}


def test_last_relation_wins_and_self_loops_count_twice(spark):
    pairs = {(r["h"], r["t"]): r["r"] for r in graph.pair_relation(toy(spark)).collect()}
    assert pairs["Alice", "Australia"] == "lives_in"
    assert graph.neighbours(toy(spark)).where("h = t").count() == 2


def test_neighbourhood_size_and_defaults(spark):
    t = toy(spark)
    alone = t.where("pos = 4").unionByName(spark.createDataFrame([(9, "Nobody", "born_in", "Nowhere")], t.schema))
    out = graph.triple_neighbourhood(alone, t, 3, "1")
    assert [r["count"] for r in out.groupBy("pos").count().collect()] == [8, 8]
    assert out.where("pos = 9").select("h", "r", "t").distinct().count() == 1


def test_corruption_avoids_known_facts(spark):
    g = triples.events_graph(spark.read.parquet(f"{SF}/events.parquet"))
    e, r = vocabulary.entity_vocabulary(g), vocabulary.relation_vocabulary(g)
    rows = vocabulary.encode(g, e, r)
    known = graph.distinct_facts(rows)
    wrong = corrupt.single_slot(rows, known, e.count(), r.count(), "3")
    assert wrong.count() == rows.count()
    assert wrong.join(known, ["h", "r", "t"], "left_semi").count() == 0
    full = corrupt.single_slot(rows.limit(5), known, e.count(), r.count(), "3", ("h", "t"))
    assert full.join(rows.select("pos", F.col("r").alias("own")), "pos").where("r != own").count() == 0


def test_saturated_slot_gives_null(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0)], "pos long, h long, r long, t long")
    assert corrupt.single_slot(rows, rows, 1, 1, "1").first()["h"] is None


def test_metrics_by_hand(spark):
    s = spark.createDataFrame([(0, 0.9, 1), (1, 0.8, 0), (2, 0.8, 1), (3, 0.1, 0)], "id long, score double, label int")
    assert ranking.roc_auc(s).first()["auc"] == pytest.approx(0.875)
    assert ranking.average_precision(s).first()["ap"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert ranking.roc_auc(s.where("label = 1")).first()["auc"] is None
    assert [r["rk"] for r in ranking.every_tenth(ranking.discovered(ranking.top_k(s, 4), 2), 4).collect()] == []


def test_records_skip_broken_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x_run.json").write_text('{"dataset": "d", "seed": 1, "neg_source": "random", "test_anomaly_source": "random", "anomaly_ratio": 0.05, "precision_at": {"0.01": 0.5}, "recall_at": {"0.01": 0.1}, "auc": 0.7}')
    (tmp_path / "a" / "y_run.json").write_text('{"dataset": ')
    (tmp_path / "other.json").write_text("{}")
    got = records.read_records(spark, str(tmp_path))
    assert got.count() == 1
    cells = {r["metric"]: r["text"] for r in experiments.aggregate(got).collect()}
    assert cells["auc"] == "0.7000" and cells["auprc"] == "--"


def test_reader_keeps_order_and_sets_bad_lines_aside(spark, tmp_path):
    for name, text in (("train", "a\tr\tb\nbroken\nb\tr\tc\n"), ("valid", "c\tr\td\n"), ("test", "")):
        (tmp_path / f"{name}.txt").write_text(text)
    good, bad = triples.read_triples(spark, str(tmp_path))
    assert [r["h"] for r in good.orderBy("pos").collect()] == ["a", "b", "c"] and bad.count() == 1
    again, _ = triples.read_triples(spark, str(tmp_path), repeat_bad=True)
    assert [r["h"] for r in again.orderBy("pos").collect()] == ["a", "a", "b", "c"]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    once = {r["id"]: r["d"] for r in df.select("id", draw("s", F.col("id")).alias("d")).collect()}
    again = {r["id"]: r["d"] for r in df.repartition(3).select("id", draw("s", F.col("id")).alias("d")).collect()}
    assert once == again


def test_stream_scores_like_the_batch(spark, tmp_path):
    from tripleguard.streaming import scoring

    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "id long, vec array<double>")
    rows = spark.createDataFrame([(0, 0, 0, 1), (1, 1, 1, 0)], "pos long, h long, r long, t long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = scoring.write_scores(scoring.scored(stream, vec, vec), str(tmp_path / "out"), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, scoring.scored(rows, vec, vec).collect()))


def test_saturated_slots_are_searched_whole(spark):
    """All but one tail is taken: its rank among the free ones finds it, and a full slot gives null."""
    known = spark.createDataFrame([(i, 0, 0, i) for i in range(199)] + [(300 + i, 1, 0, i) for i in range(200)], "pos long, h long, r long, t long")
    rows = known.where("pos in (0, 1, 2, 300)")
    got = {r["pos"]: r["t"] for r in corrupt.single_slot(rows, known, 200, 1, "1", ("t",)).collect()}
    assert got == {0: 199, 1: 199, 2: 199, 300: None}
    full = spark.createDataFrame([(0, 0, 0)], "h long, r long, t long")
    assert corrupt.fully_random(20, full, 2, 1, "1").count() == 20
    assert corrupt.fully_random(3, full, 1, 1, "1").count() == 0


def test_running_sums_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("x"))
    for parts in ("1", "3", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["id"]: r["s"] for r in vocabulary.running_sums(rows, [F.desc("id")], {"s": "x"}).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {i: sum(j % 7 for j in range(i, 500)) for i in range(500)}


def test_bad_lines_repeat_the_triple_before(spark, tmp_path):
    for name, lines in (("train", ["a\tr\tb", "bad", "worse", "c\tr\td"]), ("valid", ["none", "e\tr\tf"]), ("test", ["g\tr\th"])):
        (tmp_path / f"{name}.txt").write_text("\n".join(lines) + "\n")
    good, bad = triples.read_triples(spark, str(tmp_path), repeat_bad=True)
    assert [r["h"] for r in good.orderBy("pos").collect()] == ["a", "a", "a", "c", "c", "e", "g"] and bad.count() == 3


def test_neighbour_numbers_are_dense(spark):
    g = triples.events_graph(spark.read.parquet(f"{SF}/events.parquet"))
    rows = graph.numbered_neighbours(g, "1").groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("d"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("degree").alias("degree"))
    assert rows.where("n != d or lo != 0 or hi != n - 1 or degree != n").count() == 0


def test_sources_of_anomalies(spark, tmp_path):
    from tripleguard.sources import negatives

    t = toy(spark)
    e, r = vocabulary.entity_vocabulary(t), vocabulary.relation_vocabulary(t)
    rows = vocabulary.encode(t, e, r)
    for name in negatives.POOL_FILES:
        (tmp_path / name).write_text("Bob\tborn_in\tJapan\nCarol\tlives_in\tBob\n")
    assert negatives.anomalies(spark, "pool", 9, rows, e, r, "1", folder=str(tmp_path)).count() == 4
    (tmp_path / negatives.POOL_FILES[1]).write_text("Nobody\tborn_in\tJapan\n")
    with pytest.raises(ValueError):
        negatives.anomalies(spark, "pool", 9, rows, e, r, "1", folder=str(tmp_path))
    with pytest.raises(ValueError):
        negatives.anomalies(spark, "other", 2, rows, e, r, "1")
    same = negatives.anomalies(spark, "generator", 3, rows, e, r, "1", generate=lambda x: x)
    assert same.count() == 0  # what a generator gives back unchanged is no negative
    frozen = f"file://{tmp_path}/frozen"
    first = negatives.anomalies(spark, "random", 4, rows, e, r, "1", frozen=frozen).collect()
    assert negatives.anomalies(spark, "pool", 4, rows, e, r, "2", folder="/none", frozen=frozen).collect() == first and len(first) == 4

"""The ledger of runs, logs in the order of writing, lines in the order of blocks, pretrained vectors, and trained runs over files."""

import gzip
import os
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from tripleguard.operators import vocabulary
from tripleguard.plans import experiments, ledger, optimiser, runs
from tripleguard.sources import records, triples


def write_graph(folder):
    rng = random.Random(2)
    os.makedirs(folder)
    for split, n in (("train", 60), ("valid", 15), ("test", 15)):
        with open(f"{folder}/{split}.txt", "w") as f:
            f.writelines(f"e{(h := rng.randrange(12))}\tr{h % 2}\te{(h * 3 + rng.randrange(2)) % 12}\n" for _ in range(n))


def cells(spark, labels):
    return spark.createDataFrame([(x,) for x in labels], "label string")


def test_a_restart_runs_what_has_failed_and_nothing_twice(spark, tmp_path):
    calls, lock, broken, pools = [], threading.Lock(), {"b"}, set()

    def one(cell):
        with lock:
            calls.append(cell["label"])
            pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        if cell["label"] in broken:
            raise ValueError("no such folder\nat all")
        assert spark.range(10).count() == 10

    path = f"{tmp_path}/ledger"
    first = {r["label"]: r for r in ledger.run_cells(spark, cells(spark, "abcd"), one, path).collect()}
    assert sorted(calls) == list("abcd") and pools == {"cell-0", "cell-1"}
    assert {x: r["status"] for x, r in first.items()} == {"a": "done", "b": "failed", "c": "done", "d": "done"}
    assert first["b"]["error"].startswith("ValueError: no such folder") and first["a"]["error"] is None
    broken.clear()
    calls.clear()
    again = {r["label"]: r for r in ledger.run_cells(spark, cells(spark, "abcde"), one, path).collect()}
    assert sorted(calls) == ["b", "e"] and all(r["status"] == "done" for r in again.values()) and again["b"]["tries"] == 2
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert ledger.unfinished(cells(spark, "abf"), ledger.read_outcomes(spark, path)).collect()[0]["label"] == "f"


def test_a_cell_that_was_done_stays_done(spark):
    rows = [("x", "done", None, 1.0, 1.0), ("x", "failed", "late", 2.0, 2.0), ("y", "failed", "one", 1.0, 1.0), ("y", "failed", "two", 1.0, 3.0)]
    got = {r["label"]: (r["status"], r["error"], r["tries"], r["seconds"]) for r in ledger.latest(spark.createDataFrame(rows, ledger.OUTCOME)).collect()}
    assert got == {"x": ("done", None, 2, 3.0), "y": ("failed", "two", 2, 2.0)}


def test_a_matrix_of_trained_runs_with_a_failing_cell(spark, tmp_path):
    write_graph(f"{tmp_path}/graph")
    base = runs.Config(data=f"{tmp_path}/graph", output=f"{tmp_path}/out", model="translation", anomaly_ratio=0.2, dim=4, batch=64, max_epoch=2, rate=0.1)
    failing = {"on": True}

    def evaluate(spark, config):
        if failing["on"] and config.seed == 1:
            raise RuntimeError("lost")
        return runs.evaluate(spark, config)

    told, _ = ledger.run_matrix(spark, base, ["generator"], ["random"], [0, 1], evaluate=evaluate)
    assert {r["label"]: r["status"] for r in told.collect()} == {"translation_generatorxrandom_s0": "done", "translation_generatorxrandom_s1": "failed"}
    failing["on"] = False
    told, table = ledger.run_matrix(spark, base, ["generator"], ["random"], [0, 1], evaluate=evaluate)
    assert {r["status"] for r in told.collect()} == {"done"}
    rows = {r["metric"]: r for r in table.collect()}
    assert rows["auc"]["n"] == 2 and rows["auc"]["seeds"] == "0,1" and "±" in rows["auc"]["text"] and "precision_at:0.04" in rows
    # the log holds what the record holds
    here = f"{base.output}/translation_generatorxrandom_s0"
    record = [r for r in records.read_records(spark, base.output).collect() if r["seed"] == 0][0]
    log = records.read_log(spark, f"{here}_log")
    at = {r["k"]: (r["precision"], r["recall"]) for r in records.metrics_at(log, 0.2).collect()}
    assert at.keys() == {float(k) for k in record["precision_at"]}
    for k, v in record["precision_at"].items():
        assert at[float(k)] == (pytest.approx(v, abs=1e-6), pytest.approx(record["recall_at"][k], abs=1e-6))
    assert records.first_value(log, records.AREAS, 1).first()["value"] == pytest.approx(record["auc"], abs=1e-6)
    assert records.first_value(log, r"There are (\d+) Triples", 1).first()["value"] == 90
    lines = [r["value"] for r in log.orderBy("at").collect()]
    assert lines[0].startswith("There are 90") and lines[1].startswith("processed 108, missing 0") and lines[22] == "and 88 more"
    assert all(re.fullmatch(r"\(e\d+, r\d, e\d+\) -> \(e\d+, r\d, e\d+\) \[moved: (head|relation|tail)\]", line) for line in lines[2:22])
    assert lines[23].startswith("Epoch: 1, loss") and lines[24].startswith("Epoch: 2, loss")
    times = records.total_minutes(spark.read.text(f"{here}_epoch_times"), records.DURATION, 1).first()
    assert times["n"] == 2 and times["minutes"] > 0
    losses = [r["loss"] for r in optimiser.read_losses(spark, f"{here}_state").orderBy("epoch").collect()]
    assert len(losses) == 2 and losses[1] < losses[0]


def test_a_missing_metric_is_shown(spark, tmp_path):
    row = [("d", "m_s0", 0, "random", "random", 0.05, 1, {"0.01": 0.5}, {"0.01": 0.1}, None, 0.25)]
    records.write_records(spark.createDataFrame(row, records.RECORD.replace(", _corrupt_record string", "")), f"{tmp_path}/x_run.json")
    got = {r["metric"]: r["text"] for r in ledger.report(spark, str(tmp_path)).collect()}
    assert got == {"auc": "--", "auprc": "0.2500", "precision_at:0.01": "0.5000", "recall_at:0.01": "0.1000"}


def test_lines_are_numbered_in_order_whatever_the_blocks(spark, tmp_path):
    rng = random.Random(6)
    want = []
    for name in ("b.txt", "a.txt", "c.txt"):
        lines = ["x" * rng.randrange(60) + str(i) for i in range(3000)]
        with open(f"{tmp_path}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
        want.append((name, lines))
    want = [line for _, lines in sorted(want) for line in lines]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = triples.read_lines(spark, f"{tmp_path}").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [r["value"] for r in sorted(got, key=lambda r: r["at"])] == want and len({r["at"] for r in got}) == 9000


def test_compressed_files_keep_their_order(spark, tmp_path):
    for name in ("a", "b"):
        with gzip.open(f"{tmp_path}/{name}.gz", "wt") as f:
            f.writelines(f"{name}\n" for _ in range(5000))
    got = sorted((r["at"], r["value"]) for r in triples.read_lines(spark, str(tmp_path)).collect())
    assert [v for _, v in got] == ["a"] * 5000 + ["b"] * 5000 and len({a for a, _ in got}) == 10_000


def test_a_log_is_read_in_the_order_of_writing(spark, tmp_path):
    path = f"{tmp_path}/log"
    for i in range(4):
        records.write_log(spark, path, [f"Epoch: {i}, Duration: {i}.5 seconds, Duration: 1.0 seconds", "no"], append=i > 0)
    log = records.read_log(spark, path)
    assert [r["value"][:8] for r in log.orderBy("at").collect()] == [x for i in range(4) for x in (f"Epoch: {i}", "no")]
    found = records.matches(log, records.DURATION, 1)
    assert found.count() == 8 and found.agg(F.max_by("g1", "at")).first()[0] == "1.0"
    assert records.last_value(log, r"(Epoch): (\d)", 1, 2).first()["value"] == 3.0 and records.first_value(log, records.DURATION, 1).first()["value"] == 0.5
    assert tuple(records.total_minutes(log, records.DURATION, 1).first()) == (pytest.approx((0.5 + 1.5 + 2.5 + 3.5 + 4) / 60), 8)
    records.write_log(spark, path, ["new"], append=False)
    assert [r["value"] for r in records.read_log(spark, path).collect()] == ["new"]


def test_given_vectors_reach_the_run(spark, tmp_path):
    write_graph(f"{tmp_path}/graph")
    read, _ = triples.read_triples(spark, f"{tmp_path}/graph")
    entities, relations = vocabulary.entity_vocabulary(read), vocabulary.relation_vocabulary(read)
    n, m = entities.count(), relations.count()
    for name, size in (("ent", n), ("rel", m)):
        with open(f"{tmp_path}/{name}.txt", "w") as f:
            f.writelines(f" {i}.5  {i} {-i}e-1\n" for i in range(size))
    config = runs.Config(data=f"{tmp_path}/graph", output=f"{tmp_path}/out", model="translation", max_epoch=0, anomaly_ratio=0.2, entity_vectors=f"{tmp_path}/ent.txt", relation_vectors=f"{tmp_path}/rel.txt")
    vectors = runs.vectors_of(spark, entities, relations, config)
    assert sorted((r["id"], [round(x, 4) for x in r["vector"]]) for r in vectors[0].collect()) == [(i, [i + 0.5, float(i), round(-i / 10, 4)]) for i in range(n)]
    runs.evaluate(spark, config)  # no epoch: distances of the given vectors
    h, r, t = vocabulary.encode(read, entities, relations).orderBy("pos").select("h", "r", "t").first()
    x = lambda i: (i + 0.5, float(i), -i / 10)
    want = sum((a + b - c) ** 2 for a, b, c in zip(x(h), x(r), x(t))) ** 0.5
    assert records.read_scores(spark, f"{tmp_path}/out/{config.label}_scores").orderBy("id").first()["score"] == pytest.approx(want, abs=1e-5)
    with open(f"{tmp_path}/ent.txt", "a") as f:
        f.write("1 2 3\n")
    with pytest.raises(ValueError, match=f"{n + 1} vectors"):
        runs.vectors_of(spark, entities, relations, config)


def test_labels_of_a_matrix(spark):
    got = {r["label"] for r in experiments.matrix(spark, ["random", "generator"], ["pool"], [3], "translation").collect()}
    assert got == {"translation_randomxpool_s3", "translation_generatorxpool_s3"}
    with pytest.raises(ValueError, match="source of negatives"):
        rows = spark.createDataFrame([(0, 0, 0, 1)], "pos long, h long, r long, t long")
        runs.training_pairs(rows, rows, (2, 1), runs.Config(neg_source="elsewhere"))


def test_requirements_are_rewritten_in_order(spark, tmp_path):
    with open(f"{tmp_path}/in.txt", "w") as f:
        f.write("torch   2.1\n\n numpy\nscikit-learn 1.3 \n")
    records.rewrite_requirements(spark, f"{tmp_path}/in.txt", f"{tmp_path}/out")
    assert [r["value"] for r in triples.read_lines(spark, f"{tmp_path}/out").orderBy("at").collect()] == ["torch==2.1", "numpy", "scikit-learn==1.3"]


def test_training_and_testing_are_two_runs(spark, tmp_path):
    write_graph(f"{tmp_path}/graph")
    base = {"data": f"{tmp_path}/graph", "output": f"{tmp_path}/out", "model": "translation", "anomaly_ratio": 0.1, "dim": 4, "batch": 128, "anomaly_file": f"{tmp_path}/frozen"}
    with pytest.raises(FileNotFoundError, match="train first"):
        runs.evaluate(spark, runs.Config(mode="test", **base))
    losses = runs.evaluate(spark, runs.Config(mode="train", **base)).collect()
    assert len(losses) == 1 and losses[0]["n"] == 98  # half of the nine anomalies each way, rounded down
    record = runs.evaluate(spark, runs.Config(mode="test", **base)).first()
    assert 0 <= record["auc"] <= 1 and len(record["precision_at"]) == 5

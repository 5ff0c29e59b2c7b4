"""The encoder against a plain forward pass, losses of a batch by hand, and a whole run over files."""

import math
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tripleguard.functions import vectors as V
from tripleguard.operators import encoder, graph
from tripleguard.plans import experiments, runs, training
from tripleguard.session import scratch
from tripleguard.sources import records

DIM, HIDDEN, K = 6, 4, 2


def times(row, matrix):
    return [sum(x * m[j] for x, m in zip(row, matrix)) for j in range(len(matrix[0]))]


def added(*rows):
    return [sum(x) for x in zip(*rows)]


def plain_lstm(steps, w, name):
    n, squash = len(w[f"{name}.state"]), lambda x: 1 / (1 + math.exp(-x))
    state, cell, out = [0.0] * n, [0.0] * n, []
    for x in steps:
        z = added(times(x, w[f"{name}.input"]), times(state, w[f"{name}.state"]), w[f"{name}.bias"])
        for i in range(n):
            cell[i] = squash(z[n + i]) * cell[i] + squash(z[i]) * math.tanh(z[2 * n + i])
        state = [squash(z[3 * n + i]) * math.tanh(cell[i]) for i in range(n)]
        out.append(state)
    return out


def plain_layer(steps, w, layer):
    back = plain_lstm(steps[::-1], w, f"a{layer}b")[::-1]
    return [f + b for f, b in zip(plain_lstm(steps, w, f"a{layer}f"), back)]


def plain_dense(x, w, name):
    inner = [max(0.0, v) for v in added(times(x, w[f"{name}.w1"]), w[f"{name}.b1"])]
    return added(times(inner, w[f"{name}.w2"]), w[f"{name}.b2"])


def plain_attention(rows, w, name):
    h = [times(x, w[f"{name}.w"]) for x in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    e = [dot(x, w[f"{name}.own"]) + dot(h[0], w[f"{name}.centre"]) for x in h]
    raised = [math.exp(x if x > 0 else 0.2 * x) for x in e]
    weight = [max(0.0, x / sum(raised) - 0.001) for x in raised]
    return added(*([a * v for v in x] for a, x in zip(weight, h)))


def test_encoder_equals_a_plain_forward_pass(spark):
    facts = [(0, 0, 1), (1, 1, 2), (2, 0, 0), (0, 1, 3), (3, 0, 2)]
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(facts)], "pos long, h long, r long, t long")
    ids = lambda n: spark.range(n).withColumn("name", F.col("id").cast("string"))
    ent, rel = (encoder.initial_vectors(ids(n), DIM, kind, "1") for n, kind in ((4, "ent"), (2, "rel")))
    weights = encoder.initial_weights(DIM, HIDDEN, 1)
    around = graph.triple_neighbourhood(rows, rows, K, "1")
    got = {r["pos"]: r for r in encoder.attend(around, encoder.encode_triples(rows, ent, rel, weights), weights).collect()}

    w = {n: x.tolist() for n, x in weights.items()}
    e, r = ({x["id"]: x for x in v.collect()} for v in (ent, rel))

    def encoded(h, rr, t):
        a = plain_layer(plain_layer([e[h]["va"], r[rr]["va"], e[t]["va"]], w, 0), w, 1)
        return a, plain_lstm([e[h]["vb"], r[rr]["vb"], e[t]["vb"]], w, "b")[-1]

    places = {}
    for x in around.collect():
        places.setdefault(x["pos"], {})[x["slot"]] = encoded(x["h"], x["r"], x["t"])
    assert len(got) == len(facts)
    for pos, at in places.items():
        steps, b = at[0]
        za, zb = [], []
        for side in (0, 1):
            mine = [at[side * (K + 1) + i] for i in range(K + 1)]
            za.append(plain_attention([sum(m[0], []) for m in mine], w, "att_a"))
            zb.append(plain_attention([m[1] for m in mine], w, "att_b"))
        apart = sum(math.dist(plain_dense(y, w, "same"), plain_dense(x, w, "narrow")) for x, y in zip(za, zb))
        want = {
            "translation": math.hypot(*(x + y - z for x, y, z in zip(*steps))), "second": 1 / (1 + math.exp(-plain_dense(b, w, "score")[0])),
            "gap_a": 0.1 * math.dist(*za), "gap_b": 0.1 * math.dist(*zb), "similar": 0.1 * apart,
        }
        for name, value in want.items():
            assert got[pos][name] == pytest.approx(value, abs=1e-5), (pos, name)


def test_losses_of_a_batch(spark):
    names = [f"{c}{end}" for end in ("", "_neg") for c in ("translation", "second", "gap_a", "gap_b", "similar")]
    rows = [(0, 1.0, 0.2, 0.1, 0.2, 0.5, 1.5, 0.9, 0.1, 0.1, 0.25), (0, 2.0, 0.4, 0.1, 0.0, 0.7, 1.0, 0.1, 0.2, 0.1, 0.35), (1, 1.0, 0.5, 0.0, 0.0, 0.0, 3.0, 0.5, 0.0, 0.0, 0.0)]
    got = {r["batch_id"]: r for r in training.batch_losses(spark.createDataFrame(rows, ["batch_id", *names])).collect()}

    def divergence(p, q):
        p, q = ([math.exp(x) / sum(map(math.exp, v)) for x in v] for v in (p, q))
        return sum(x * math.log(x / y) for x, y in zip(p, q)) / len(p)

    want = {"n": 2, "margin": (1.3 - 1.7 + 0.5 + 2.1 - 1.3 + 0.5) / 2, "kl_pos": divergence([1, 2], [0.2, 0.4]), "kl_neg": divergence([1.5, 1], [0.9, 0.1]), "similar_pos": 0.6, "similar_neg": 0.3, "pos_loss": 0.85, "neg_loss": 0.75}
    want["total"] = sum(want[c] for c in ("margin", "kl_pos", "kl_neg", "similar_pos", "similar_neg"))
    for name, value in want.items():
        assert got[0][name] == pytest.approx(value), name
    assert got[1]["total"] == pytest.approx(0.0)


def write_graph(folder):
    os.makedirs(folder)
    for split, first in (("train", 0), ("valid", 30), ("test", 40)):
        with open(f"{folder}/{split}.txt", "w") as f:
            f.writelines(f"e{i % 9}\tr{i % 2}\te{(i * 4 + 1) % 11}\n" for i in range(first, first + (30 if split == "train" else 10)))


def test_a_run_writes_scores_times_and_a_record(spark, tmp_path):
    write_graph(f"{tmp_path}/graph")
    weights = encoder.initial_weights(DIM, HIDDEN, 5)
    encoder.save_weights(spark, weights, f"{tmp_path}/weights")
    read = encoder.load_weights(spark, f"{tmp_path}/weights")
    assert all((read[n] == w).all() for n, w in weights.items()) and len(read) == len(weights)
    config = runs.from_session(spark, data=f"{tmp_path}/graph", output=f"{tmp_path}/out", anomaly_ratio=0.2, neighbours=3, dim=DIM, hidden=HIDDEN, seed=3, weights=f"{tmp_path}/weights", anomaly_file=f"{tmp_path}/frozen")
    runs.evaluate(spark, config)
    scores = records.read_scores(spark, f"{tmp_path}/out/{config.label}_scores")
    assert scores.count() == 50 + scores.where("label = 1").count() and scores.where("label = 1").count() == 10
    again = {(r["id"], round(r["score"], 5)) for r in scores.collect()}
    runs.evaluate(spark, config)  # the frozen anomalies are met again
    assert {(r["id"], round(r["score"], 5)) for r in records.read_scores(spark, f"{tmp_path}/out/{config.label}_scores").collect()} == again
    row = records.read_records(spark, f"{tmp_path}/out").collect()
    assert len(row) == 1 and row[0]["model"] == "encoder_randomxrandom_s3" and 0 <= row[0]["auc"] <= 1
    assert sorted(row[0]["precision_at"]) == ["0.04", "0.08", "0.12", "0.16", "0.2"]
    assert row[0]["recall_at"]["0.2"] == pytest.approx(row[0]["precision_at"]["0.2"])  # as many ranks as anomalies
    assert experiments.cells(records.read_records(spark, f"{tmp_path}/out")).first()["ks"] == ["0.04", "0.08", "0.12", "0.16", "0.2"]


def test_a_missing_graph_stops_a_run(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)path"):
        runs.evaluate(spark, runs.Config(data=f"{tmp_path}/none", output=f"{tmp_path}/out"))


def test_session_settings_are_typed_and_arguments_win(spark):
    spark.conf.set("tripleguard.anomaly_ratio", "0.15")
    spark.conf.set("tripleguard.neighbours", "7")
    try:
        config = runs.from_session(spark, neighbours=9)
    finally:
        spark.conf.unset("tripleguard.anomaly_ratio")
        spark.conf.unset("tripleguard.neighbours")
    assert (config.anomaly_ratio, config.neighbours, config.dim) == (0.15, 9, 100)


def test_durations_are_appended_or_replaced(spark, tmp_path):
    for epoch, seconds in enumerate((30.0, 90.0)):
        records.write_duration(spark, f"{tmp_path}/epochs", f"Epoch: {epoch}", seconds, append=True)
        records.write_duration(spark, f"{tmp_path}/test", "Test", seconds)
    told = [records.total_minutes(spark.read.text(f"{tmp_path}/{name}"), r"Duration:\s+([\d.]+)", 1).first() for name in ("epochs", "test")]
    assert [(r["minutes"], r["n"]) for r in told] == [(2.0, 2), (1.5, 1)]


def test_activations_and_dropout(spark):
    x = spark.range(-1, 2).select(F.col("id").cast("double").alias("x"))
    got = [tuple(r) for r in x.select(V.relu(F.col("x")), F.round(V.elu(F.col("x")), 4), F.round(V.sigmoid(F.col("x")), 4)).collect()]
    assert sorted(got) == [(0.0, -0.6321, 0.2689), (0.0, 0.0, 0.5), (1.0, 1.0, 0.7311)]
    many = spark.range(4000).select(V.dropout(F.lit(1.0), 0.2, "1", F.col("id")).alias("y"))
    zero = many.where("y = 0").count()
    assert 700 < zero < 900 and many.where("y = 1.25").count() == 4000 - zero


def test_negatives_with_nulls_are_counted_and_left_out_of_batches(spark):
    pairs = spark.createDataFrame([(0, 0, 0, 1, 2, 0, 1), (1, 1, 0, 2, None, None, None), (2, 2, 0, 0, 2, 0, 0)], "pos long, h long, r long, t long, h2 long, r2 long, t2 long")
    from tripleguard.sources import negatives

    told = negatives.statistics(pairs, pairs).first().asDict()
    assert told == {"processed": 3, "missing": 1, "used_original": 1, "type_valid": 2, "moved_head": 1, "moved_tail": 0}
    batches = graph.paired_batches(pairs, pairs, 2, 1, "1")
    assert batches.count() == 2 * 2 * 6 and {r["pos"] for r in batches.collect()} == {0, 2}
    assert batches.select("batch_id", "pos").distinct().count() == 2


@pytest.mark.parametrize("settings, root", [({"spark.master": "local[8]"}, "file:///tmp/checkpoints/"), ({"spark.master": "local"}, "file:///tmp/checkpoints/"), ({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///c/"}, "hdfs:///c/"), ({"spark.master": "yarn"}, None), ({"spark.master": "local-cluster[3,2,1024]"}, None)])
def test_steps_go_to_the_shared_folder(settings, root):
    session = SimpleNamespace(conf=settings)
    if root is None:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch(session, "step")
    else:
        assert scratch(session, "step").startswith(f"{root}step-")

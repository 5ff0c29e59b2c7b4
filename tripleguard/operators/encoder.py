"""The two-view encoder with given weights: LSTMs over head, relation and tail, and gated attention over neighbourhoods.

The first view is a two-layer bidirectional LSTM whose three steps stand side by side (six times the hidden size); the second is
the last step of one LSTM. A triple's encoding depends on the triple alone, so each distinct triple is encoded once, and its
neighbourhoods take it by a join. Vectors of entities and relations are tables and grow with the graph; the weights don't.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.functions.vectors import initial_vector
from tripleguard.operators import graph
from tripleguard.operators.graph import IN, OUT, pools, sampled
from tripleguard.session import in_slices, materialised

Weights = dict[str, np.ndarray]

ENCODED = "a array<float>, b array<float>, translation double, second double"
#: What a row takes from the pool of its head to that of its tail.
HALF = f"pos bigint, e bigint, degree bigint, {ENCODED}, za array<double>, zb array<double>, apart double"
#: Encoded rows, or edges of pools, up to which all are worked on at once: some kB of shuffle files each.
WIDE = 5_000_000
ATTENDED = "pos bigint, translation double, second double, gap_a double, gap_b double, similar double"


def shapes(dim: int, hidden: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all weights, for vectors of dim values and LSTMs of hidden values a direction."""
    wide, found = 6 * hidden, {}
    for name, size in (("a0f", dim), ("a0b", dim), ("a1f", 2 * hidden), ("a1b", 2 * hidden), ("b", dim)):
        found |= {f"{name}.input": (size, 4 * hidden), f"{name}.state": (hidden, 4 * hidden), f"{name}.bias": (4 * hidden,)}
    found |= {"att_a.w": (wide, wide), "att_a.own": (wide,), "att_a.centre": (wide,), "att_b.w": (hidden, hidden), "att_b.own": (hidden,), "att_b.centre": (hidden,)}
    for name, sizes in (("score", (hidden, hidden // 2, 1)), ("narrow", (wide, wide // 2, hidden)), ("same", (hidden, hidden, hidden))):
        found |= {f"{name}.w1": sizes[:2], f"{name}.b1": sizes[1:2], f"{name}.w2": sizes[1:], f"{name}.b2": sizes[2:]}
    return found


def initial_weights(dim: int, hidden: int, seed: int) -> Weights:
    """Uniform weights, as wide as one over the square root of the input."""
    rng = np.random.default_rng(seed)
    return {name: rng.uniform(-1, 1, shape) / math.sqrt(shape[0]) for name, shape in shapes(dim, hidden).items()}


def save_weights(spark: SparkSession, weights: Weights, path: str) -> None:
    """Writes a table name, shape, values, in place of what is there."""
    rows = [(name, list(w.shape), w.ravel().tolist()) for name, w in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    """The weights of a table; their size is fixed by dim and hidden, whatever the graph."""
    return {row["name"]: np.array(row["values"]).reshape(row["shape"]) for row in spark.read.parquet(path).collect()}


def initial_vectors(vocabulary: DataFrame, dim: int, kind: str, seed: str) -> DataFrame:
    """id, va, vb: vectors of an id for both views."""
    view = lambda v: initial_vector(dim, seed, kind, v, F.col("id")).cast("array<float>").alias(f"v{v}")
    return vocabulary.select("id", view("a"), view("b"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, weights: Weights, name: str, backwards: bool = False) -> np.ndarray:
    """Outputs of each step; x: rows, steps, values."""
    hidden = weights[f"{name}.state"].shape[0]
    state, cell = np.zeros((len(x), hidden)), np.zeros((len(x), hidden))
    out = np.zeros((len(x), x.shape[1], hidden))
    for step in reversed(range(x.shape[1])) if backwards else range(x.shape[1]):
        gates = x[:, step] @ weights[f"{name}.input"] + state @ weights[f"{name}.state"] + weights[f"{name}.bias"]
        enter, forget, new, leave = np.split(gates, 4, axis=1)
        cell = _sigmoid(forget) * cell + _sigmoid(enter) * np.tanh(new)
        state = _sigmoid(leave) * np.tanh(cell)
        out[:, step] = state
    return out


def both_ways(x: np.ndarray, weights: Weights, layer: int) -> np.ndarray:
    return np.concatenate([lstm(x, weights, f"a{layer}f"), lstm(x, weights, f"a{layer}b", True)], axis=2)


def two_layers(x: np.ndarray, weights: Weights, name: str) -> np.ndarray:
    """A dense layer with what is above 0, and a second one."""
    return np.maximum(x @ weights[f"{name}.w1"] + weights[f"{name}.b1"], 0) @ weights[f"{name}.w2"] + weights[f"{name}.b2"]


def attention(x: np.ndarray, weights: Weights, name: str, alpha: float, mu: float) -> np.ndarray:
    """Gated attention of groups x (groups, rows, values) around their first rows."""
    h = x @ weights[f"{name}.w"]
    e = h @ weights[f"{name}.own"] + (h[:, :1] @ weights[f"{name}.centre"])
    e = np.where(e > 0, e, alpha * e)
    raised = np.exp(e - e.max(axis=1, keepdims=True))
    weight = np.maximum(raised / raised.sum(axis=1, keepdims=True) - mu, 0)
    return np.einsum("gr,grv->gv", weight, h)


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """rows, values: a column of lists of one length; null ones are left out."""
    lists = batch.column(name)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists) - lists.null_count, -1)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def encoded_rows(rows: DataFrame, entities: DataFrame, relations: DataFrame, weights: Weights) -> DataFrame:
    """rows (h, r, t and others) with a, b, translation and second (the second view's score). entities, relations: id, va, vb."""
    shared, names = rows.sparkSession.sparkContext.broadcast(weights), rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            if batch.num_rows:
                view = lambda v: np.stack([_flat(batch, f"v{v}_{c}") for c in "hrt"], axis=1)  # noqa: B023, E731
                steps = both_ways(both_ways(view("a"), w, 0), w, 1)
                b = lstm(view("b"), w, "b")[:, -1]
                made = [_lists(steps.reshape(len(b), -1).astype(np.float32)), _lists(b.astype(np.float32))]
                made += [pa.array(np.linalg.norm(steps[:, 0] + steps[:, 1] - steps[:, 2], axis=1)), pa.array(_sigmoid(two_layers(b, w, "score"))[:, 0])]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + made, [*names, "a", "b", "translation", "second"])

    named = lambda v, c: v.select(F.col("id").alias(c), F.col("va").alias(f"va_{c}"), F.col("vb").alias(f"vb_{c}"))
    met = rows.join(named(entities, "t"), "t").join(named(entities, "h"), "h").join(named(relations, "r"), "r")  # relations last, so that their vectors go through no other shuffle
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return met.select(*names, *(f"v{v}_{c}" for v in "ab" for c in "hrt")).mapInArrow(work, f"{kinds}, {ENCODED}")


def encode_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, weights: Weights) -> DataFrame:
    """h, r, t, a, b, translation and second of each distinct triple; see encoded_rows()."""
    return encoded_rows(triples.select("h", "r", "t").distinct(), entities, relations, weights)


def attend(neighbourhood: DataFrame, encoded: DataFrame, weights: Weights, alpha: float = 0.2, mu: float = 0.001, weight: float = 0.1) -> DataFrame:
    """For each pos: translation and second of its own triple, the distance of its two sides in each view, and how far the views are apart.

    neighbourhood: pos, slot (0 to 2k+1), h, r, t; a group is the 2k+2 rows of one pos. Groups of a task are worked on together, as many as a batch holds.
    """
    shared = neighbourhood.sparkSession.sparkContext.broadcast(weights)

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        """The result of the groups in rows, which are in order and of one size."""
        w, n = shared.value, rows["pos"].nunique()
        sides = lambda c: np.stack(rows[c]).astype(float).reshape(2 * n, len(rows) // (2 * n), -1)
        za, zb = attention(sides("a"), w, "att_a", alpha, mu), attention(sides("b"), w, "att_b", alpha, mu)
        apart = np.linalg.norm(two_layers(zb, w, "same") - two_layers(za, w, "narrow"), axis=1)
        gap = lambda z: weight * np.linalg.norm(z[0::2] - z[1::2], axis=1)
        one = {"gap_a": gap(za), "gap_b": gap(zb), "similar": weight * (apart[0::2] + apart[1::2])}
        return rows.iloc[:: len(rows) // n][["pos", "translation", "second"]].assign(**one)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups come one behind the other; the last of a batch waits for the next one, as it may go on there."""
        rest: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch["pos"] == batch["pos"].iloc[-1]
            if rest and rest[-1]["pos"].iloc[-1] != batch["pos"].iloc[-1] or not last.all():
                done = pd.concat([*rest, batch[~last]])
                if len(done):
                    yield whole(done)
                rest = []
            rest.append(batch[last])
        if rest:
            yield whole(pd.concat(rest))

    joined = neighbourhood.join(encoded, ["h", "r", "t"]).select("pos", "slot", "translation", "second", "a", "b")
    parts = int(neighbourhood.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(parts, "pos").sortWithinPartitions("pos", "slot").mapInPandas(work, ATTENDED)


def attend_pool(own: np.ndarray, pool: np.ndarray | None, picks: np.ndarray | None, k: int, weights: Weights, name: str, alpha: float, mu: float) -> np.ndarray:
    """attention() of groups that take their k neighbours from one pool. own: projected first rows; pool: projected edges, or None if the row stands in; picks: k places in it for each group, or None for all of it."""
    if pool is None:
        return own * (1 + k) * max(1 / (1 + k) - mu, 0)
    centre, logits = own @ weights[f"{name}.centre"], pool @ weights[f"{name}.own"]
    e = np.concatenate([(own @ weights[f"{name}.own"])[:, None], np.broadcast_to(logits, (len(own), len(pool))) if picks is None else logits[picks]], axis=1) + centre[:, None]
    e = np.where(e > 0, e, alpha * e)
    raised = np.exp(e - e.max(axis=1, keepdims=True))
    weight = np.maximum(raised / raised.sum(axis=1, keepdims=True) - mu, 0)
    near = weight[:, 1:]
    if picks is not None:  # a place that is picked more than once weighs as often
        cell = np.arange(len(own))[:, None] * len(pool) + picks
        near = np.bincount(cell.ravel(), near.ravel(), len(own) * len(pool)).reshape(len(own), -1)
    return own * weight[:, :1] + near @ pool


def _attend_side(rows: DataFrame, around: DataFrame, weights: Weights, side: int, k: int, seed: str, alpha: float, mu: float, weight: float) -> DataFrame:
    """rows (pos, e, degree of e, encoding and, for the tail's side, what the head's gave and e_next) behind the pools of their e (around: e, degree, near_a, near_b).

    A pool and the rows of its entity come one behind the other in a task, so it moves and is projected once; an entity of more than
    graph.LARGE edges is dealt out to as many tasks as it holds that number, by pos.
    """
    spark = rows.sparkSession
    shared, names = spark.sparkContext.broadcast(weights), [c for c in rows.columns if c not in ("e", "degree")]
    several = F.ceil(F.coalesce("degree", F.lit(1)) / graph.LARGE).cast("int")
    asked = rows.withColumns({"part": F.pmod(F.xxhash64("pos"), several).cast("int"), "of_row": F.lit(True)})
    pooled = around.withColumns({"part": F.explode(F.sequence(F.lit(0), several - 1)), "of_row": F.lit(False)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["e", "part", "of_row"]
    sorted_ = asked.unionByName(pooled, allowMissingColumns=True).repartition(parts, "e", "part").sortWithinPartitions(*order)
    plain = (F.col("degree") > k) if side == OUT else (F.col("degree") >= k)
    met = sorted_.withColumn("picks", F.when(F.col("of_row") & ~plain, sampled(k, side, seed, "row", F.col("pos"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, at, pool = shared.value, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            e, part, of_row = (batch.column(c).to_numpy(zero_copy_only=False) for c in order)
            mine = batch.filter(pa.array(of_row))
            own = {v: _flat(mine, v) @ w[f"att_{v}.w"] if mine.num_rows else None for v in "ab"}
            z = {v: np.zeros_like(own[v]) if mine.num_rows else None for v in "ab"}
            row, picked = np.concatenate([[0], np.cumsum(of_row)]), mine.column("picks")
            starts = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (part[1:] != part[:-1])]))
            for low, high in zip(starts, [*starts[1:], n]):
                if (e[low], part[low]) != at:  # else the entity goes on from the batch before
                    at, pool = (e[low], part[low]), {"a": None, "b": None}
                if not of_row[low]:
                    pool = {v: batch.column(f"near_{v}")[low].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, w[f"att_{v}.w"].shape[0]) @ w[f"att_{v}.w"] for v in "ab"}
                first, last = row[low], row[high]
                if first < last:
                    some = picked.slice(first, last - first)
                    picks = None if some.null_count else some.flatten().to_numpy(zero_copy_only=False).reshape(last - first, k)
                    for v in "ab":
                        z[v][first:last] = attend_pool(own[v][first:last], pool[v], picks, k, w, f"att_{v}", alpha, mu)
            if mine.num_rows:
                apart = np.linalg.norm(two_layers(z["b"], w, "same") - two_layers(z["a"], w, "narrow"), axis=1)
                keep = [mine.column(c) for c in ("pos", "translation", "second")]
                if side == OUT:
                    half = [mine.column("e_next"), mine.column("degree_next"), mine.column("a"), mine.column("b")]
                    yield pa.RecordBatch.from_arrays([keep[0], *half, *keep[1:], _lists(z["a"]), _lists(z["b"]), pa.array(apart)], ["pos", "e", "degree", "a", "b", "translation", "second", "za", "zb", "apart"])
                else:
                    gaps = [pa.array(weight * np.linalg.norm(z[v] - _flat(mine, f"z{v}"), axis=1)) for v in "ab"]
                    similar = pa.array(weight * (apart + mine.column("apart").to_numpy()))
                    yield pa.RecordBatch.from_arrays([*keep, *gaps, similar], ["pos", "translation", "second", "gap_a", "gap_b", "similar"])

    return met.select(*order, *names, "near_a", "near_b", "picks").mapInArrow(work, HALF if side == OUT else ATTENDED)


def attend_rows(rows: DataFrame, triples: DataFrame, entities: DataFrame, relations: DataFrame, weights: Weights, k: int, seed: str, alpha: float = 0.2, mu: float = 0.001, weight: float = 0.1) -> DataFrame:
    """What attend() gives for the neighbourhoods of rows (pos, h, r, t), without unfolding them in a shuffle.

    All that can be sampled around an entity are the k edges of its pool. A pool is encoded and gathered once; a row is encoded, meets the
    pool of its head and then, with what that gave, the pool of its tail. Large tables are worked on in slices of WIDE. entities, relations: id, va, vb.
    """
    near = pools(triples, k, seed)
    degree = near.select(F.col("e").alias("id"), "degree")
    entities, relations = materialised(entities.select("id", "va", "vb").join(degree, "id", "left")), materialised(relations.select("id", "va", "vb"))

    def gathered(keep) -> DataFrame:
        edges = keep(near, "e").select("e", "degree", F.posexplode("near").alias("i", "x")).select("e", "degree", "i", "x.h", "x.r", "x.t")
        found = encoded_rows(edges, entities, relations, weights).groupBy("e").agg(F.first("degree").alias("degree"), F.array_sort(F.collect_list(F.struct("i", "a", "b"))).alias("near"))
        flat = lambda c: F.flatten(F.transform("near", lambda x: x[c])).alias(f"near_{c}")
        return found.select("e", "degree", flat("a"), flat("b"))

    around = in_slices(near.agg(F.sum(F.size("near"))).first()[0] or 0, gathered, WIDE)

    def attended(keep) -> DataFrame:
        of = lambda c, name: entities.select(F.col("id").alias(c), F.col("degree").alias(name))
        mine = keep(rows.select("pos", "h", "r", "t"), "h").join(of("t", "degree_next"), "t").join(of("h", "degree"), "h")
        encoded = encoded_rows(mine, entities, relations, weights).select("pos", F.col("h").alias("e"), "degree", F.col("t").alias("e_next"), "degree_next", "a", "b", "translation", "second")
        half = _attend_side(encoded, keep(around, "e"), weights, OUT, k, seed, alpha, mu, weight)
        return _attend_side(half, around, weights, IN, k, seed, alpha, mu, weight)

    return in_slices(rows.count(), attended, WIDE)


def anomaly_scores(attended: DataFrame) -> DataFrame:
    """pos, score: the translation and the distances of both views."""
    return attended.select("pos", (F.col("translation") + F.col("gap_a") + F.col("gap_b")).alias("score"))

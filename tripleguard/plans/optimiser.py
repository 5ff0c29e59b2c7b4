"""Training of translational vectors: gradients and Adam moments as tables, one step a batch, one written state an epoch.

The parameters are rows (kind, id, x, m, v): the vector of an entity or relation and its two moments. A step joins the
vectors of each pair of a batch (one that a negative shares with its triple once), takes the gradient of the margin max(0, |h + r - t| - |h2 + r2 - t2| + gamma) in closed form, sums it
by row and moves every row as Adam does. Nothing but two numbers a step (pairs and loss) comes to the driver, and the tables grow with the graph.

A state is kept when an epoch is over, with its loss written behind it; training that was stopped goes on from the last such epoch
and gives the same tables, since orders and initial vectors are drawn from the seed, the epoch and the ids.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.functions.vectors import initial_vector
from tripleguard.operators.corrupt import batches, iterations
from tripleguard.session import exists, remove, stored

#: Kind and column of the six vectors of a pair, and the sign of each in its distance; the second three are the negative's.
PLACES = (("e", "h", 1.0), ("r", "r", 1.0), ("e", "t", -1.0), ("e", "h2", 1.0), ("r", "r2", 1.0), ("e", "t2", -1.0))
KEY = ["kind", "id"]
BETA, SECOND_BETA, EPSILON = 0.9, 0.999, 1e-8


def initial_state(entities: DataFrame, relations: DataFrame, dim: int, seed: str) -> DataFrame:
    """kind, id, x, m, v: drawn vectors and no moments."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    one = lambda v, kind: v.select(F.lit(kind).alias("kind"), "id", initial_vector(dim, seed, kind, F.col("id")).alias("x"), zeros.alias("m"), zeros.alias("v"))
    return one(entities, "e").unionByName(one(relations, "r"))


def given_state(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """kind, id, x, m, v of given vectors (id, vector)."""
    zeros = F.transform("vector", lambda _: F.lit(0.0))
    one = lambda v, kind: v.select(F.lit(kind).alias("kind"), "id", F.col("vector").cast("array<double>").alias("x"), zeros.alias("m"), zeros.alias("v"))
    return one(entities, "e").unionByName(one(relations, "r"))


def _members(pairs: DataFrame, keep: list[str], negatives: bool = True) -> DataFrame:
    """keep, kind, id, a, b of each vector that a triple or a pair is made of: its signs in the distances of the triple and of the negative.

    A slot that a negative shares with its triple is one row, so a pair has four of them where one slot is replaced.
    """
    parts = []
    for (kind, c, sign), (_, c2, _) in zip(PLACES[:3], PLACES[3:]):
        row = lambda of, a, b, kind=kind: F.struct(F.lit(kind).alias("kind"), F.col(of).alias("id"), a.alias("a"), b.alias("b"))
        same = F.col(c) == F.col(c2) if negatives else F.lit(False)
        parts.append(row(c, F.lit(sign), F.when(same, F.lit(sign)).otherwise(F.lit(0.0))))
        if negatives:
            parts.append(F.when(~same, row(c2, F.lit(0.0), F.lit(sign))))
    return pairs.select(*keep, F.explode(F.array(*parts)).alias("s")).where("s is not null").select(*keep, "s.*")


def _sums(members: DataFrame, state: DataFrame, keep: list[str], dim: int, signs: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """keep and, for each of the signs, the components of the signed sum of the vectors: a0, a1, ..., b0, b1, ... An id that the state lacks is an error of the caller's.

    Components are columns of their own, so sums are made by hashing, and partly before the shuffle; no vector is put in a list.
    """
    held = members.join(state.select(*KEY, *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(dim))), KEY)
    return held.groupBy(*keep).agg(*(F.sum(F.col(f"x{i}") * F.col(c)).alias(f"{c}{i}") for c in signs for i in range(dim)))


def _length(sign: str, dim: int) -> Column:
    return F.sqrt(reduce(Column.__add__, (F.col(f"{sign}{i}") * F.col(f"{sign}{i}") for i in range(dim))))


def gradients(pairs: DataFrame, state: DataFrame, dim: int, gamma: float) -> DataFrame:
    """kind, id, g, loss and n: the sums over the pairs of the gradient, and (each pair's once) of the loss and of the pairs.

    Where the margin is met there is none; at a distance of 0 the gradient is 0. The sums are combined before the shuffle, so a hub
    or a relation of very many pairs doesn't gather their vectors in one task.
    """
    keep = ["pos", *(c for _, c, _ in PLACES)]
    found = _sums(_members(pairs, keep), state, keep, dim).withColumns({"s": _length("a", dim), "s2": _length("b", dim)})
    found = found.withColumn("loss", F.greatest(F.lit(0.0), F.col("s") - F.col("s2") + gamma))
    # the share of each component in the gradient; the negative's with the opposite sign
    scale = lambda s, sign: F.when((F.col("loss") > 0) & (F.col(s) > 0), F.lit(sign) / F.col(s)).otherwise(F.lit(0.0))
    units = found.withColumns({"u": scale("s", 1.0), "u2": scale("s2", -1.0)}).select(*keep, "loss", *((F.col(u) * F.col(f"{c}{i}")).alias(f"{c}{i}") for c, u in (("a", "u"), ("b", "u2")) for i in range(dim)))
    rows = _members(units, units.columns[len(keep):])
    first = (F.col("kind") == "e") & (F.col("a") > 0)  # the head of the triple: one row a pair
    sums = rows.groupBy(*KEY).agg(
        *(F.sum(F.col("a") * F.col(f"a{i}") + F.col("b") * F.col(f"b{i}")).alias(f"g{i}") for i in range(dim)),
        F.sum(F.when(first, F.col("loss")).otherwise(F.lit(0.0))).alias("loss"), F.sum(F.when(first, 1).otherwise(0)).alias("n"),
    )
    return sums.select(*KEY, F.array(*(f"g{i}" for i in range(dim))).alias("g"), "loss", "n")


def adam(state: DataFrame, gradient: DataFrame, n: int, step: int, rate: float) -> DataFrame:
    """state after a step (numbered from 1) along the mean of the gradient over n pairs; rows without one move by their moments."""
    g = F.coalesce(F.transform("g", lambda x: x / n), F.transform("x", lambda _: F.lit(0.0)))
    moved = state.join(gradient.select(*KEY, "g"), KEY, "left").withColumn("g", g)
    mixed = moved.withColumns({
        "m": F.zip_with("m", "g", lambda m, x: m * BETA + x * (1 - BETA)), "v": F.zip_with("v", "g", lambda v, x: v * SECOND_BETA + x * x * (1 - SECOND_BETA)),
    })
    push = F.zip_with("m", "v", lambda m, v: m / (1 - BETA**step) / (F.sqrt(v / (1 - SECOND_BETA**step)) + EPSILON))
    return mixed.select(*KEY, F.zip_with("x", push, lambda x, p: x - p * rate).alias("x"), "m", "v")


def _epochs_done(spark: SparkSession, path: str) -> int:
    done = 0
    while exists(spark, f"{path}/loss-{done + 1}/_SUCCESS"):
        done += 1
    return done


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """epoch, n, loss (mean over the pairs), seconds of the epochs that are over."""
    return spark.read.schema("epoch long, n long, loss double, seconds double").json(f"{path}/loss-*")


def read_state(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """kind, id, x, m, v at the end of an epoch, the last one if none is named."""
    at = _epochs_done(spark, path) if epoch is None else epoch
    return spark.read.parquet(f"{path}/state-{at}")


def train(
    pairs: DataFrame, start: DataFrame, path: str, epochs: int, dim: int, size: int, seed: str, rate: float = 0.01, gamma: float = 0.5, keep: int | None = None, told: Callable[[int, float, float], None] | None = None
) -> DataFrame:
    """The state after so many epochs, written below the path with one of each epoch; goes on from what is there.

    pairs: pos, h, r, t, h2, r2, t2; those without a negative take no part. size: pairs in a batch. keep: how many of the last
    states stay (all, if none). told: called with epoch, loss and seconds.
    """
    spark = start.sparkSession
    pairs, pairs_at = stored(pairs.where("h2 is not null and r2 is not null and t2 is not null").select("pos", "h", "r", "t", "h2", "r2", "t2"))
    steps = iterations(pairs.count(), size)
    done = _epochs_done(spark, path)
    state = read_state(spark, path, done) if done else stored(start, f"{path}/state-0")[0]
    for epoch in range(done + 1, epochs + 1):
        began, total, count, last = time.time(), 0.0, 0, None
        placed, placed_at = stored(batches(pairs, size, seed, epoch))
        for i in range(steps):
            gradient, gradient_at = stored(gradients(placed.where(F.col("batch_id") == i), state, dim, gamma))
            n, loss = gradient.agg(F.sum("n"), F.sum("loss")).first()
            final = i == steps - 1
            state, state_at = stored(adam(state, gradient, n, (epoch - 1) * steps + i + 1, rate), f"{path}/state-{epoch}" if final else None)
            remove(spark, gradient_at, *([last] if last else []))
            last, total, count = None if final else state_at, total + loss, count + n
        if not steps:
            state, _ = stored(state, f"{path}/state-{epoch}")
        row = [(epoch, count, total / count if count else None, time.time() - began)]
        spark.createDataFrame(row, "epoch long, n long, loss double, seconds double").coalesce(1).write.mode("overwrite").json(f"{path}/loss-{epoch}")
        remove(spark, placed_at, *([f"{path}/state-{epoch - keep}"] if keep and epoch > keep else []))
        if told:
            told(*row[0][:1], *row[0][2:])
    remove(spark, pairs_at)
    return state


def distances(triples: DataFrame, state: DataFrame) -> DataFrame:
    """pos, score: |h + r - t| of each triple."""
    row = state.select(F.size("x").alias("n")).first()
    dim = row["n"] if row else 0
    if not dim:
        return triples.select("pos", F.lit(0.0).alias("score")).where(F.lit(False))
    return _sums(_members(triples, ["pos"], False), state, ["pos"], dim, ("a",)).select("pos", _length("a", dim).alias("score"))

"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each quantised by its own codebook; a cell is a pair of
centroids. A query ranks the centroids of each half and visits pairs in the order of their summed
distance (minus the inner product with the two centroids) with a heap, until the visited cells hold
the asked share of the index. Entries of visited cells are reranked by the exact inner product in double precision.

The codebooks are fitted on sample vectors at most (those of the smallest hash of the id), a stated bound;
every row is indexed. Queries and entries meet block by block: an entry goes to one block by the
hash of its id, so that a crowded cell spreads over all blocks, and each block answers each query block
with its best k; a last aggregation keeps the best k of all.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those whose length is not the commonest one. Ties go to the smaller id;
repeated rows count as entries of their own; rows of one id ask once, with the smallest of their vectors. An empty index or no query gives an empty result; further columns may have
any name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import written


@dataclass
class Codebooks:
    """Centroids of the two halves, k each, and how many entries each cell holds."""

    left: np.ndarray
    right: np.ndarray
    held: np.ndarray | None = None


def usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)


def visit(query: np.ndarray, books: Codebooks, wanted: int) -> list[int]:
    """Cells in the order of summed distance until they hold so many entries (or all are visited)."""
    half = books.left.shape[1]
    far_left, far_right = -(books.left @ query[:half]), -(books.right @ query[half:])
    by_left, by_right = np.argsort(far_left, kind="stable"), np.argsort(far_right, kind="stable")
    a, b = far_left[by_left].tolist(), far_right[by_right].tolist()
    n_left, n_right, held = len(a), len(b), books.held
    heap, cells, got = [(a[0] + b[0], 0, 0)], [], 0
    done = [0] * n_left  # how many of each row have been taken: a pair enters once both before it are out
    pushed = {(0, 0)}
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(by_left[i]) * n_right + int(by_right[j])
        done[i] = j + 1
        if n := int(held[cell]):
            cells.append(cell)
            got += n
        if i + 1 < n_left and (i + 1, j) not in pushed and done[i + 1] >= j:
            pushed.add((i + 1, j))
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < n_right and (i, j + 1) not in pushed and (i == 0 or done[i - 1] >= j + 2):
            pushed.add((i, j + 1))
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return cells


def block_best(queries: pd.DataFrame, entries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k entries of this block for each query, among the cells that the query visits."""
    q_ids = queries["query_id"].to_numpy()
    q = np.array(queries["vector"].tolist())
    order = np.argsort(entries["cell"].to_numpy(), kind="stable")
    cells, ids, x = entries["cell"].to_numpy()[order], entries["vec_id"].to_numpy()[order], np.array(entries["vector"].tolist())[order]
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    place = {int(c): i for i, c in enumerate(cells[starts])}
    bounds = np.r_[starts, len(cells)]
    asks: list[list[int]] = [[] for _ in starts]
    for i, visited in enumerate(queries["cells"]):
        for c in visited:
            if (at := place.get(int(c))) is not None:
                asks[at].append(i)
    least = np.full(len(q), -np.inf)  # the k-th best so far, less the rounding of a matrix product
    # a sum of n products is off by n roundings of the product of the norms at most, here and in the exact score
    slack = 4 * (q.shape[1] + 1) * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n_kept = 0

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        qi, ei, s = (np.concatenate(parts) for parts in zip(*kept, strict=True))
        order = np.lexsort((ids[ei], -s, qi))
        qi, ei, s = qi[order], ei[order], s[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        full = rank == k - 1
        least[qi[full]] = s[full] - slack[qi[full]]
        keep = (rank < k) | (s >= least[qi])
        return qi[keep], ei[keep], s[keep]

    for at, own in enumerate(asks):
        if not own:
            continue
        lo, hi = bounds[at], bounds[at + 1]
        own_array = np.array(own)
        for part in range(lo, hi, 4096):
            scores = q[own_array] @ x[part : min(hi, part + 4096)].T
            rows, columns = np.nonzero((scores >= least[own_array][:, None]) & (ids[None, part : min(hi, part + 4096)] != q_ids[own_array][:, None]))
            kept.append((own_array[rows], columns + part, scores[rows, columns]))
            n_kept += len(rows)
            if n_kept > 500_000:
                kept = [best()]
                n_kept = 0
    if not kept:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    qi, ei, _ = best()
    exact = np.concatenate([np.zeros(0), *((q[qi[i : i + 20_000]] * x[ei[i : i + 20_000]]).sum(axis=1) for i in range(0, len(qi), 20_000))])
    order = np.lexsort((ids[ei], -exact, qi))
    qi, ei, exact = qi[order], ei[order], exact[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return pd.DataFrame({"query_id": q_ids[qi[keep]], "vec_id": ids[ei[keep]], "score": exact[keep]})


def fit(vectors: DataFrame, k: int, sample: int) -> Codebooks | None:
    """Codebooks of k centroids a half from sample rows at most. vectors: vec_id, vector."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").collect()
    if not rows:
        return None
    x = np.array([r["vector"] for r in rows])
    half = x.shape[1] // 2
    return Codebooks(k_means(x[:, :half], k), k_means(x[:, half:], k))


def search(
    embeddings: DataFrame,
    queries: Column,
    k: int = 20,
    share: float = 0.5,
    centroids: int = 64,
    sample: int = 20_000,
    entries_per_block: int = 16_384,
    queries_per_block: int = 2_048,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row for which queries holds.

    share: the part of the index that each query visits before reranking, at every size.
    """
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks")).where(usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if length is not None:
        rows = rows.where(F.size("vector") == length["n"])
    books = fit(rows, centroids, sample)
    result = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    if books is None:
        return spark.createDataFrame([], result)
    held = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                b = held.value
                x = np.array(rows["vector"].tolist())
                half = b.left.shape[1]
                yield rows.assign(cell=nearest(x[:, :half], b.left) * len(b.right) + nearest(x[:, half:], b.right))

    index, _ = written(rows.mapInPandas(coded, "vec_id long, vector array<double>, asks boolean, cell long"))
    n_cells = len(books.left) * len(books.right)
    counts = np.zeros(n_cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # bounded by the number of cells
        counts[r["cell"]] = r["count"]
    books.held = counts
    full = spark.sparkContext.broadcast(books)
    total = int(counts.sum())
    wanted = max(int(np.ceil(share * total)), k + 1)  # the query's own entry may be among them
    n_entries, n_queries = max(1, -(-total // entries_per_block)), max(1, -(-index.where("asks").count() // queries_per_block))

    def visiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"query_id": rows["vec_id"], "vector": rows["vector"], "cells": [visit(np.asarray(v), full.value, wanted) for v in rows["vector"]]})

    asked = index.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).mapInPandas(visiting, "query_id long, vector array<double>, cells array<int>")
    asked = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_queries)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_entries - 1).cast("long"))).alias("eb"))
    entries = index.select("vec_id", "vector", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(n_entries)).alias("eb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("qb"))
    found = (
        asked.groupBy("qb", "eb")
        .cogroup(entries.groupBy("qb", "eb"))
        .applyInPandas(lambda a, b: block_best(a, b, k) if len(a) and len(b) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}), "query_id long, vec_id long, score double")
    )
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k)
    return found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")

"""Adjacency, pair relation, neighbours and their samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.functions.draws import draw, draw_below
from tripleguard.operators.scan import running_in_groups
from tripleguard.operators.vocabulary import dense_ids
from tripleguard.session import in_slices, materialised

OUT, IN = 0, 1
#: Groups over which the edges of one entity are numbered.
PARTS = 64
#: Edges of an entity above which no task gathers them all: each drops what can't be among the first before the shuffle.
LARGE = 100_000


def distinct_facts(triples: DataFrame) -> DataFrame:
    return triples.select("h", "r", "t").distinct()


def _adjacency(triples: DataFrame, end: str, other: str, name: str, size: int) -> DataFrame:
    one = triples.select(end, other).distinct().withColumn("_one", F.lit(1).cast("long"))
    placed = running_in_groups(one, [end], [other], "_one", "_at").withColumn("part", F.floor((F.col("_at") - 1) / size))
    return placed.groupBy(end, "part").agg(F.array_sort(F.collect_list(other)).alias(name))


def out_adjacency(triples: DataFrame, size: int = 10_000) -> DataFrame:
    """h, part, tails: the sorted set of an entity's tails, cut into parts of the size, so that a hub is neither one row nor one task."""
    return _adjacency(triples, "h", "t", "tails", size)


def in_adjacency(triples: DataFrame, size: int = 10_000) -> DataFrame:
    """t, part, heads: as out_adjacency, the other way round."""
    return _adjacency(triples, "t", "h", "heads", size)


def pair_relation(triples: DataFrame) -> DataFrame:
    """(h, t) and the relation read last."""
    return triples.groupBy("h", "t").agg(F.max_by("r", "pos").alias("r"))


def neighbours(triples: DataFrame) -> DataFrame:
    """e, side, h, r, t: edges of each entity, outgoing before incoming; a self loop is on both sides."""
    return _both_sides(pair_relation(triples))


def _both_sides(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("h").alias("e"), F.lit(OUT).alias("side"), "h", "r", "t").unionByName(edges.select(F.col("t").alias("e"), F.lit(IN).alias("side"), "h", "r", "t"))


def degrees(triples: DataFrame) -> DataFrame:
    return neighbours(triples).groupBy("e").agg(F.count(F.lit(1)).alias("degree"))


def numbered_neighbours(triples: DataFrame, seed: str) -> DataFrame:
    """e, i (from 0, in the order of a draw), degree, h, r, t: one row for each edge of an entity.

    Edges are numbered inside parts of the draw and each part starts where the ones before it end, so that a hub is spread over PARTS groups.
    """
    edges = neighbours(triples).withColumn("w", draw(seed, "nbr", F.col("e"), F.col("side"), F.col("h"), F.col("t")))
    parted = edges.withColumn("part", F.floor(F.col("w") / ((1 << 32) // PARTS)))
    sizes = parted.groupBy("e", "part").agg(F.count(F.lit(1)).alias("n"))
    of_entity = Window.partitionBy("e")
    before = of_entity.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("e", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(of_entity).alias("degree"))
    at = F.row_number().over(Window.partitionBy("e", "part").orderBy("w", "side", "h", "r", "t")) - 1
    return parted.withColumn("at", at).join(starts, ["e", "part"]).select("e", (F.col("start") + F.col("at")).alias("i"), "degree", "h", "r", "t")


def sampled(k: int, side: int, *key: Column | str) -> Column:
    """Indexes of k neighbours out of degree: without repeats above k, else with; the tail side takes exactly k as they are."""
    plain = (F.col("degree") > k) if side == OUT else (F.col("degree") >= k)
    at = lambda i: F.when(plain, i.cast("bigint")).otherwise(draw_below(F.col("degree"), *key, str(side), i))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at)


def pools(triples: DataFrame, k: int, seed: str, above: int = 0, wanted: DataFrame | None = None) -> DataFrame:
    """e, degree, near: the first k edges (h, r, t) of each entity in the order of a draw, or all of fewer: whatever can be sampled for it.

    above: only entities of more edges. wanted: only entities of this table (e, once each, and columns that go on). An edge is drawn
    and put in order only for such an entity. Pairs, degrees and pools are evaluated one behind the other, large ones in slices.
    Edges of an entity go through one shuffle to one task; those of more than LARGE are cut to k in each task before theirs.
    """
    n, more = triples.count(), [c for c in wanted.columns if c != "e"] if wanted is not None else []
    edges = _both_sides(in_slices(n, lambda keep: pair_relation(keep(triples.select("pos", "h", "r", "t"), "h", "t")).select("h", "r", "t")))

    def counted(keep) -> DataFrame:
        found = keep(edges.select("e"), "e").groupBy("e").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > above)
        return found if wanted is None else found.join(keep(wanted, "e"), "e")

    asked = in_slices(2 * n, counted)
    large = materialised(asked.where(F.col("degree") > LARGE).select("e"))  # no more than the edges by LARGE
    hubs = not large.isEmpty()

    def gathered(drawn: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy("e").orderBy("w", "side", "h", "r", "t"))
        return drawn.withColumn("i", at).where(F.col("i") <= k).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("i", "h", "r", "t"))).alias("near"))

    def first(keep) -> DataFrame:
        drawn = lambda x: x.withColumn("w", draw(seed, "nbr", F.col("e"), F.col("side"), F.col("h"), F.col("t")))
        mine, ours = keep(asked, "e"), keep(edges, "e")
        few = ours.join(F.broadcast(large), "e", "left_anti") if hubs else ours
        near = gathered(drawn(few.join(mine.select("e"), "e", "left_semi")))
        if hubs:
            near = near.unionByName(gathered(drawn(ours.join(F.broadcast(large), "e", "left_semi"))))
        return near.join(mine, "e").select("e", "degree", *more, F.transform("near", lambda x: F.struct(x["h"].alias("h"), x["r"].alias("r"), x["t"].alias("t"))).alias("near"))

    return in_slices(2 * n, first)


def sample_entities(triples: DataFrame, k: int, side: int, seed: str, above: int = 0) -> DataFrame:
    """e, slot, h, r, t: k sampled edges of each entity of more edges than above."""
    near = pools(triples, k, seed, above)
    picked = F.transform(sampled(k, side, seed, "slot", F.col("e")), lambda i: F.get("near", i.cast("int")))
    return near.select("e", F.posexplode(picked).alias("slot", "x")).select("e", "slot", "x.h", "x.r", "x.t")


def ends(rows: DataFrame) -> DataFrame:
    """e, heads, tails: each entity of rows, and on which sides it stands."""
    sides = F.array(*(F.struct(F.col(c).alias("e"), F.lit(c == "h").alias("heads"), F.lit(c == "t").alias("tails")) for c in "ht"))
    return rows.select(F.explode(sides).alias("x")).select("x.*").groupBy("e").agg(F.bool_or("heads").alias("heads"), F.bool_or("tails").alias("tails"))


def triple_neighbourhood(rows: DataFrame, triples: DataFrame, k: int, seed: str, keep: Sequence[str] = ()) -> DataFrame:
    """pos, columns to keep, slot (0 to 2k+1), h, r, t: each row, k edges of its head, the row again, k edges of its tail.

    An entity without edges is filled up with the row itself. A row meets the pool of its entity once and is unfolded behind that
    join, so the 2k + 2 rows of a neighbourhood go through no shuffle. Pools are made for the ends of rows alone.
    """
    near = pools(triples, k, seed, wanted=materialised(ends(rows)))
    sides = []
    for side, end in ((OUT, "h"), (IN, "t")):
        own = F.struct("h", "r", "t")
        met = near.where("heads" if side == OUT else "tails").select(F.col("e").alias(end), "degree", "near")
        joined = rows.select("pos", *keep, "h", "r", "t").join(met, end, "left")
        picked = F.transform(sampled(k, side, seed, "row", F.col("pos")), lambda i: F.get("near", i.cast("int")))
        whole = F.concat(F.array(own), F.when(F.col("degree").isNull(), F.array_repeat(own, k)).otherwise(picked))
        sides.append(joined.select("pos", *keep, F.posexplode(whole).alias("at", "x")).select("pos", *keep, (F.col("at") + side * (k + 1)).alias("slot"), "x.h", "x.r", "x.t"))
    return sides[0].unionByName(sides[1])


def expanded_batches(rows: DataFrame, triples: DataFrame, k: int, size: int, seed: str) -> DataFrame:
    """batch_id, pos, slot, h, r, t and label: labelled rows in their order, cut into batches, each with its neighbourhood."""
    placed = dense_ids(rows.select("pos", "h", "r", "t", "label"), "pos").withColumn("batch_id", F.floor(F.col("id") / size))
    return triple_neighbourhood(placed, triples, k, seed, ["batch_id", "label"]).select("batch_id", "pos", "slot", "h", "r", "t", "label")


def paired_rows(pairs: DataFrame, size: int, seed: str) -> DataFrame:
    """batch_id, pos, h, r, t: both triples of each pair in its batch, the positive at twice its pos and the negative behind it, so that they draw their neighbours apart.

    pairs: pos, h, r, t, h2, r2, t2; one without a negative is left out.
    """
    from tripleguard.operators.corrupt import batches

    whole = pairs.where("h2 is not null and r2 is not null and t2 is not null").select("pos", "h", "r", "t", "h2", "r2", "t2")
    ends = F.array(F.struct((2 * F.col("pos")).alias("pos"), "h", "r", "t"), F.struct((2 * F.col("pos") + 1).alias("pos"), F.col("h2").alias("h"), F.col("r2").alias("r"), F.col("t2").alias("t")))
    return batches(whole, size, seed).select("batch_id", F.explode(ends).alias("x")).select("batch_id", "x.*")


def paired_batches(pairs: DataFrame, triples: DataFrame, k: int, size: int, seed: str) -> DataFrame:
    """batch_id, pos, y (1, or -1 for a negative), slot, h, r, t: training batches in a drawn order, both triples of a pair with their neighbourhoods.

    pairs: pos, h, r, t, h2, r2, t2; one without a negative is left out.
    """
    around = triple_neighbourhood(paired_rows(pairs, size, seed), triples, k, seed, ["batch_id"])
    y = F.when(F.col("pos") % 2 == 0, F.lit(1)).otherwise(F.lit(-1)).alias("y")
    return around.select("batch_id", F.floor(F.col("pos") / 2).alias("pos"), y, "slot", "h", "r", "t")


def pairs_with_replacement(pairs: DataFrame, n: int, seed: str, epoch: int = 0) -> DataFrame:
    """slot (0 to n-1) and the columns of pairs: n draws with replacement, by place in the order of pos, so that how often a pair comes doesn't depend on partitions."""
    numbered = materialised(dense_ids(pairs, "pos"))
    size = numbered.count()
    picks = pairs.sparkSession.range(n if size else 0).select(F.col("id").alias("slot"), draw_below(max(size, 1), seed, "pick", epoch, F.col("id")).alias("id"))
    return picks.join(numbered, "id").drop("id")


def embedded_batches(batch: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """batch_id, n and tensor: the vectors of head, relation and tail of a batch's rows, one behind the other in the order of pos and slot, as doubles.

    batch: batch_id, pos, slot, h, r, t; entities, relations: id, vector; a row that lacks a vector is left out. A batch is one row, bounded by
    its size times the neighbourhood. It meets each vector once, and its tensor is put together inside the task, so that goes through no shuffle.
    """
    gathered = materialised(batch.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slot", "h", "r", "t"))).alias("rows")))

    def met(vectors: DataFrame, name: str, *ends: str) -> DataFrame:
        asked = gathered.select("batch_id", F.explode(F.array_distinct(F.concat(*(F.col(f"rows.{c}") for c in ends)))).alias("id"))
        return asked.join(vectors.select("id", "vector"), "id").groupBy("batch_id").agg(F.collect_list(F.struct("id", "vector")).alias(name))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for i in range(found.num_rows):
                rows, known, places, start = found.column("rows")[i].values, [], [], 0
                for name, ends in (("ents", "ht"), ("rels", "r")):
                    held = found.column(name)[i].values
                    ids = held.field("id").to_numpy()
                    order = np.argsort(ids)
                    for c in ends:
                        wanted = rows.field(c).to_numpy(zero_copy_only=False)
                        at = order[np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)]
                        places.append(np.where(ids[at] == wanted, start + at, -1))
                    known.append(held.field("vector").cast(pa.list_(pa.float64())))
                    start += len(ids)
                h, t, r = places
                at = np.stack([h, r, t], axis=1)
                at = at[(at >= 0).all(axis=1)]
                if len(at):
                    tensor = pa.concat_arrays(known).take(pa.array(at.ravel()))
                    whole = pa.ListArray.from_arrays([0, len(values := tensor.flatten())], values) if not tensor.null_count else pa.array([None], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([found.column("batch_id").slice(i, 1), pa.array([len(at)]), whole], ["batch_id", "n", "tensor"])

    whole = gathered.join(met(entities, "ents", "h", "t"), "batch_id").join(met(relations, "rels", "r"), "batch_id")
    return whole.mapInArrow(work, f"batch_id {batch.schema['batch_id'].dataType.simpleString()}, n bigint, tensor array<double>")


def type_pool(pairs: DataFrame, triples: DataFrame, end: str) -> DataFrame:
    """Pairs (r, end) that occur: the entities that a relation has been seen with on that end."""
    return pairs.join(triples.select("r", end).distinct(), ["r", end], "left_semi")

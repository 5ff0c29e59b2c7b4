"""Where negatives and test anomalies come from: draws, a pool of verified ones, or a frozen set."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.functions.draws import draw, draw_below
from tripleguard.operators import corrupt, scan
from tripleguard.operators.scan import first_rows, large_groups, nth_free, union
from tripleguard.operators.vocabulary import decode, dense_ids, encode
from tripleguard.session import materialised
from tripleguard.sources.triples import frozen_or, read_lines, split_triples

# The files of a verified pool.
POOL_FILES = ("valid_negatives.txt", "test_negatives.txt")


def read_pool(spark: SparkSession, folder: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """pos, h, r, t of all verified negatives. A missing file, a bad line and an unknown name are errors."""
    parts = [split_triples(read_lines(spark, f"{folder}/{name}")).select(F.lit(i).alias("file"), "at", "h", "r", "t") for i, name in enumerate(POOL_FILES)]
    named = reduce(DataFrame.unionByName, parts)
    encoded = encode(named, entities, relations)
    if named.count() != encoded.count():
        raise ValueError(f"the pool in {folder} has bad lines, or names that the vocabulary lacks")
    return encoded.select((F.col("at") + F.col("file").cast("bigint") * F.lit(1 << 60)).alias("pos"), "h", "r", "t")


def _nth_in_pool(asks: DataFrame, pool: DataFrame, few: DataFrame) -> DataFrame:
    """pos, h, t, side, r, e: the k-th entity (from 0) of the pool (side, r, e, rank) that few (side, r, other, and sorted _e of scan.LONG at most) doesn't hold.

    Its rank is k and how many held ones don't stand behind it. Entities of a pool are in order, so these are counted by the entity at the rank
    that is known so far, from k on; that count grows until it stays. Where it is still growing after two looks (held ones stand close
    together), what is held is numbered by ranks instead; elsewhere it needs none.
    """
    side, keys = ["side", "r"], ["side", "r", "other"]
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(scan.LONG.bit_length()))))
    # behind the end of the array there is null, so the step isn't taken
    further = lambda at, step: F.when(F.get("_e", at + step - 1) <= F.col("e"), at + step).otherwise(at)

    def looked(at: DataFrame, c: str) -> DataFrame:
        met = at.join(pool, [*side, "rank"], "left").join(few, keys, "left")
        return materialised(met.select(*at.columns, "e", F.aggregate(steps, F.lit(0), further).cast("long").alias(c)))

    one = looked(asks.withColumn("rank", F.col("k")), "c")
    moved = looked(one.where("c > 0").select(*asks.columns, "c", (F.col("k") + F.col("c")).alias("rank")), "c2")
    ends = ("pos", "h", "t", "side", "r", "e")
    found = one.where("c = 0 or side is null").select(*ends).unionByName(moved.where("c = c2").select(*ends))
    rest = moved.where("c != c2").select(*asks.columns)
    if rest.isEmpty():
        return found
    ranked = few.join(rest.select(*keys).distinct(), keys, "left_semi").select(*keys, F.explode("_e").alias("e")).join(pool, [*side, "e"])
    late = nth_free(rest, ranked.select(*keys, F.col("rank").alias("u")), keys, name="rank")
    return found.unionByName(late.join(pool, [*side, "rank"]).select(*ends))


def type_pool_negatives(rows: DataFrame, known: DataFrame, seed: str) -> DataFrame:
    """pos, slot, h, r, t of each row with its head or its tail replaced by an entity that its relation has been seen with there.

    Masks: the new triple is no known fact and none of the rows, so it is never the row itself. How corruptible a slot is, is how many
    entities its pool has left; one draw below the sum of both chooses slot and rank, so every allowed triple is as likely. The rank is
    looked up among the gaps in the pool's numbering. Rows that have nothing left stay, with null slot, h, r and t.
    """
    one, side = F.lit(1).cast("long"), ["side", "r"]
    ends = lambda t, other: [t.select(F.lit(c).alias("side"), "r", *([F.col(o).alias("other")] if other else []), F.col(c).alias("e")) for c, o in (("h", "t"), ("t", "h"))]
    numbered = dense_ids(union(ends(known, False)).distinct(), [*side, "e"])
    first = F.broadcast(numbered.groupBy(*side).agg(F.min("id").alias("first")))  # two rows a relation
    pool = materialised(numbered.join(first, side).select(*side, "e", (F.col("id") - F.col("first")).alias("rank")))
    keys = [*side, "other"]
    wanted = materialised(union([rows.select(F.lit(c).alias("side"), "r", F.col(o).alias("other")) for c, o in (("h", "t"), ("t", "h"))]).distinct())
    # what stands in a pool is known there, so that only the rows have to be looked up
    own = materialised(union(ends(rows, True)).join(pool.select(*side, "e"), [*side, "e"], "left_semi"))
    masked = union([*ends(known, True), own])
    large = materialised(large_groups(masked, keys).join(wanted, keys, "left_semi"))
    hubs, held = not large.isEmpty(), None
    few = masked.join(F.broadcast(large), keys, "left_anti") if hubs else masked
    few = materialised(few.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("e")).alias("_e")))
    taken = few.select(*keys, F.size("_e").cast("long").alias("taken"))
    if hubs:
        held = materialised(masked.join(F.broadcast(large), keys, "left_semi").distinct().join(pool, [*side, "e"]).select(*keys, F.col("rank").alias("u")))
        taken = taken.unionByName(held.groupBy(*keys).agg(F.count(one).alias("taken")))
    sizes = pool.groupBy(*side).agg(F.count(one).alias("size"))

    def left(of: DataFrame, c: str, o: str) -> DataFrame:
        size = sizes.where(F.col("side") == c).select("r", "size")
        gone = taken.where(F.col("side") == c).select("r", F.col("other").alias(o), "taken")
        free = F.coalesce("size", F.lit(0)) - F.coalesce("taken", F.lit(0))
        return of.join(size, "r", "left").join(gone, ["r", o], "left").withColumn(f"free_{c}", free).drop("size", "taken")

    counted = left(left(rows.select("pos", "h", "r", "t"), "h", "t"), "t", "h")
    total = F.col("free_h") + F.col("free_t")
    drawn = materialised(counted.withColumn("x", F.when(total > 0, draw_below(total, seed, "corruptible", F.col("pos")))))
    head = F.col("x") < F.col("free_h")
    asks = drawn.select(
        "pos", "h", "t", F.when(head, "h").when(~head, "t").alias("side"), "r", F.when(head, F.col("t")).otherwise(F.col("h")).alias("other"), F.when(head, F.col("x")).otherwise(F.col("x") - F.col("free_h")).alias("k")
    )
    found = _nth_in_pool(asks.join(F.broadcast(large), keys, "left_anti") if hubs else asks, pool, few)
    if hubs:
        many = nth_free(asks.join(F.broadcast(large), keys, "left_semi"), held, keys, hubs=large)
        found = found.unionByName(many.withColumnRenamed("free", "rank").join(pool, [*side, "rank"], "left").select(*found.columns))
    found = found.withColumnRenamed("side", "slot")
    put = lambda c: F.when(F.col("slot") == c, F.col("e")).when(F.col("slot").isNotNull(), F.col(c)).alias(c)
    return found.select("pos", "slot", put("h"), F.when(F.col("slot").isNotNull(), F.col("r")).alias("r"), put("t"))


def oversampled(rows: DataFrame, n: int, generate: Callable[[DataFrame], DataFrame], seed: str) -> DataFrame:
    """pos, h, r, t: the first n negatives, in a drawn order, that differ from their source.

    half as many sources again are drawn, as a generator may give some back as they were or not at all. generate: rows -> pos, h, r, t.
    """
    sources = corrupt.sample(rows, int(1.5 * n) + 1, seed).select("pos", "h", "r", "t")
    made = generate(sources).select("pos", *(F.col(c).alias(f"{c}2") for c in "hrt")).where("h2 is not null and r2 is not null and t2 is not null")
    genuine = corrupt.changed(sources.join(made, "pos")).where("moved != 'NONE'")
    return corrupt.sample(materialised(genuine), n, seed).select("pos", *(F.col(f"{c}2").alias(c) for c in "hrt"))


def anomalies(spark: SparkSession, source: str, n: int, rows: DataFrame, entities: DataFrame, relations: DataFrame, seed: str, folder: str | None = None, generate: Callable[[DataFrame], DataFrame] | None = None, frozen: str | None = None) -> DataFrame:
    """h, r, t of n anomalies from the source random, pool (folder) or generator (generate, or else type_pool_negatives); count what comes, as it may be fewer.

    frozen: a path that wins over the source where it exists, and is written where it doesn't.
    """

    def make() -> DataFrame:
        if source == "pool":
            pool = read_pool(spark, folder or "", entities, relations)
            return first_rows(pool, [(draw(seed, "pool", F.col("pos")), False), (F.col("pos"), False)], n)
        if source == "generator":
            return oversampled(rows, n, generate or (lambda sources: type_pool_negatives(sources, rows, seed)), seed)
        if source == "random":
            known, sizes = rows.select("h", "r", "t").distinct(), (entities.count(), relations.count())
            one = corrupt.single_slot(corrupt.sample(rows, n // 2, seed), known, *sizes, seed).where("h is not null")
            return one.select("pos", "h", "r", "t").unionByName(corrupt.fully_random(n // 2, known, *sizes, seed))
        raise ValueError(f"unknown source of anomalies: {source}")

    made = make if frozen is None else (lambda: frozen_or(spark, frozen, entities, relations, make))
    return made().select("h", "r", "t")


def preview(pairs: DataFrame, entities: DataFrame, relations: DataFrame, limit: int = 20) -> DataFrame:
    """pos, positive, negative (as names) and moved of the first pairs (pos, h, r, t and h2, r2, t2) by pos."""
    first = corrupt.changed(materialised(pairs.orderBy("pos").limit(limit)))

    def named(columns: list[str], name: str) -> DataFrame:
        ids = first.select("pos", *(F.col(c).alias(x) for c, x in zip(columns, "hrt")))
        return decode(ids, entities, relations).select("pos", F.concat_ws(", ", "h", "r", "t").alias(name))

    both = named(["h", "r", "t"], "positive").join(named(["h2", "r2", "t2"], "negative"), "pos", "left")
    return both.join(first.select("pos", "moved"), "pos").select("pos", "positive", "negative", "moved")


def statistics(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """One row of counts over pairs (h, r, t and negatives h2, r2, t2): processed, missing, used_original, type_valid, moved_head, moved_tail.

    A negative is type_valid if its relation occurs with its head and with its tail.
    """
    seen = lambda end: triples.select(F.col("r").alias("r2"), F.col(end).alias(f"{end}2"), F.lit(True).alias(f"{end}_seen")).distinct()
    marked = corrupt.changed(pairs).join(seen("h"), ["r2", "h2"], "left").join(seen("t"), ["r2", "t2"], "left")
    given = F.col("h2").isNotNull() & F.col("r2").isNotNull() & F.col("t2").isNotNull()
    counts = {
        "missing": ~given, "used_original": F.col("moved") == "NONE", "type_valid": F.col("h_seen") & F.col("t_seen"),
        "moved_head": given & (F.col("moved") == "head"), "moved_tail": given & (F.col("moved") == "tail"),
    }
    return marked.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(c).alias(name) for name, c in counts.items()))


def told(pairs: DataFrame, triples: DataFrame, entities: DataFrame, relations: DataFrame, limit: int = 20) -> list[str]:
    """What a log says of pairs (pos, h, r, t and h2, r2, t2): one line of counts, and a line for each of the first ones, as names."""
    counts = statistics(pairs, triples).first().asDict()
    shown = preview(pairs, entities, relations, limit).orderBy("pos").collect()  # limit rows
    lines = [", ".join(f"{name} {n}" for name, n in counts.items())]
    lines += [f"({r['positive']}) -> ({r['negative'] or 'none'}) [moved: {r['moved']}]" for r in shown]
    rest = counts["processed"] - len(shown)
    return [*lines, f"and {rest} more"] if rest else lines

"""Ordered work on whole tables without a task that holds a whole group: running sums in groups, the n-th free number, and the first n rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.session import materialised

#: Rows between two bounds below which their keys are put in order on the driver.
EDGE = 1024
#: How far from the wanted share the two bounds of a round lie.
MARGIN = 0.005
#: Taken numbers of a group up to which they are one array.
LONG = 2_000
#: Size of a domain up to which the taken numbers of a group are the bits of one number.
BITS = 64


def running_in_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, name: str = "upto") -> DataFrame:
    """rows with the sum of amount over the rows of the same keys up to this one, in an order that no two of them share.

    A range shuffle by keys and order spreads a large group over many parts. Each part sums its own rows; what earlier parts hold
    of a group concerns only the first and the last group of a part, so the table that is joined has two rows a part at most.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    key = F.struct(*keys)
    ends = placed.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select("_part", F.explode(F.array_distinct(F.array("a", "b"))).alias("x")).select("_part", "x.*")
    at = ["_part", *keys]
    totals = placed.join(F.broadcast(ends), at).groupBy(*at).agg(F.sum(amount).alias("_held"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*at, F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_carried"))
    own = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn(name, F.sum(amount).over(own)).join(F.broadcast(carried), at, "left")
    return summed.withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_part", "_carried")


def _rank(k) -> Callable[[Column], Column]:
    return k if callable(k) else lambda _: F.col(k)


def large_groups(taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys of more than LONG rows."""
    return taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG).select(*keys)


class Held(NamedTuple):
    """Taken numbers: groups of LONG at most as sorted arrays (keys, _u), larger ones from ordered() (None without such), and the keys of these."""

    arrays: DataFrame
    placed: DataFrame | None
    hubs: DataFrame


def held(taken: DataFrame, keys: Sequence[str], hubs: DataFrame | None = None, keep: bool = False) -> Held:
    """taken (keys, u) in the form that nth_free() searches. keep: for several searches, so all of it is evaluated once. hubs: see nth_free()."""
    hubs = materialised(large_groups(taken, keys) if hubs is None else hubs)
    few, placed = taken, None
    if not hubs.isEmpty():
        few, placed = taken.join(hubs, list(keys), "left_anti"), ordered(taken.join(hubs, list(keys), "left_semi"), keys)
    arrays = few.groupBy(*keys).agg(F.array_sort(F.collect_set("u")).alias("_u"))
    return Held(materialised(arrays) if keep else arrays, placed, hubs)


def nth_free(asks: DataFrame, taken: DataFrame | Held, keys: Sequence[str], k: str | Callable[[Column], Column] = "k", name: str = "free", hubs: DataFrame | None = None) -> DataFrame:
    """asks with the k-th number (from 0) that taken (keys, u; repeats count once; or what held() makes of it) doesn't hold for the keys; null where k is.

    k: a column, or a function of how many numbers are taken for the keys. hubs: the keys of large_groups(), if the caller knows them.
    The i-th taken number u has u - i free ones below it, so the k-th free number is k plus how many taken ones have no more than k below them.
    A group of LONG rows at most is one sorted array, in which that count is searched; larger groups are merged in order, see nth_in_order().
    """
    at = taken if isinstance(taken, Held) else held(taken, keys, hubs)
    if at.placed is None:
        return _nth_in_arrays(asks, at.arrays, keys, k, name)
    few, many = (asks.join(at.hubs, list(keys), how) for how in ("left_anti", "left_semi"))
    return _nth_in_arrays(few, at.arrays, keys, k, name).unionByName(nth_in_order(many, at.placed, keys, k, name))


def _nth_in_arrays(asks: DataFrame, arrays: DataFrame, keys: Sequence[str], k, name: str) -> DataFrame:
    kind = arrays.schema["_u"].dataType.elementType
    ranked = asks.join(arrays, list(keys), "left").withColumn("_k", _rank(k)(F.coalesce(F.size("_u"), F.lit(0)).cast("long")).cast(kind))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(LONG.bit_length()))))
    # behind the end of the array there is null, so the step isn't taken
    further = lambda at, step: F.when(F.get("_u", at + step - 1) - (at + step - 1) <= F.col("_k"), at + step).otherwise(at)
    return ranked.select(*asks.columns, (F.col("_k") + F.aggregate(steps, F.lit(0), further)).cast(kind).alias(name))


def as_bits(taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _bits: the taken numbers, below BITS, as bits of one number."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("u").cast("int"))
    return taken.groupBy(*keys).agg(F.bit_or(one).alias("_bits"))


def nth_in_bits(asks: DataFrame, bits: DataFrame, keys: Sequence[str], size: int, k: str | Callable[[Column], Column] = "k", name: str = "free") -> DataFrame:
    """As nth_free(), for numbers below size (BITS at most) from as_bits(); null also where fewer than k + 1 of them are free."""
    none = F.lit(0).cast("bigint")
    met = asks.join(bits, list(keys), "left").withColumn("_bits", F.coalesce("_bits", none))
    ranked = met.withColumn("_k", _rank(k)(F.bit_count("_bits").cast("long")).cast("int"))
    free = F.filter(F.array(*map(F.lit, range(size))).cast("array<long>"), lambda i: F.call_function("shiftright", F.col("_bits"), i.cast("int")).bitwiseAND(F.lit(1)) == 0)
    return ranked.select(*asks.columns, F.get(free, "_k").alias(name))


def ordered(taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, u, _part, _row: each number once, range-sorted by keys and number; its part and its place in there."""
    parts = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = taken.select(*keys, "u").distinct().repartitionByRange(parts, *keys, "u").sortWithinPartitions(*keys, "u").withColumn("_at", F.monotonically_increasing_id())
    return materialised(placed.select(*keys, "u", F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))


def nth_in_order(asks: DataFrame, placed: DataFrame, keys: Sequence[str], k: str | Callable[[Column], Column] = "k", name: str = "free") -> DataFrame:
    """As nth_free(), for taken numbers from ordered(), whatever the size of a group.

    What each part holds of a group (two groups a part are cut at most) tells how many taken numbers lie before the part, and thus which part
    an ask concerns; there both are merged in order and counted. An ask that lies between two parts is answered without.
    """
    one, kind, keys = F.lit(1).cast("long"), placed.schema["u"].dataType, list(keys)
    pieces = placed.groupBy("_part", *keys).agg(F.count(one).alias("_n"), F.min("u").alias("_low"), F.max("u").alias("_high"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_held")
    pieces = materialised(pieces.select("_part", *keys, "_n", "_low", "_high", "_first", before))
    piece = F.struct("_part", (F.col("_low") - F.col("_held")).cast(kind).alias("_from"), (F.col("_high") - F.col("_held") - F.col("_n") + 1).cast(kind).alias("_to"), "_held", "_n")
    index = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"), F.sum("_n").alias("_all"))
    ranked = asks.join(index, keys, "left").withColumn("_v", _rank(k)(F.coalesce("_all", F.lit(0)).cast("long")).cast(kind))
    reached = F.size(F.filter("_pieces", lambda p: p["_from"] <= F.col("_v")))
    met = materialised(ranked.select(F.struct(*asks.columns).alias("_ask"), "_v", F.when(reached > 0, F.get("_pieces", reached - 1)).alias("_p")))
    known = F.when(F.col("_p").isNull(), F.lit(0)).when(F.col("_v") >= F.col("_p._to"), F.col("_p._held") + F.col("_p._n"))
    direct = met.where(known.isNotNull()).select("_ask.*", (F.col("_v") + known).cast(kind).alias(name))
    at = ["_part", *keys]
    free_below = F.col("u") - F.col("_held") - (F.col("_row") - F.col("_first"))
    numbers = placed.join(F.broadcast(pieces.select(*at, "_held", "_first")), at).select(*at, free_below.cast(kind).alias("_v"), F.lit(None).cast(met.schema["_ask"].dataType).alias("_ask"), F.lit(0).cast("long").alias("_held"), one.alias("_one"))
    wanted = met.where(known.isNull()).select("_p._part", *(f"_ask.{c}" for c in keys), "_v", "_ask", "_p._held", F.lit(0).cast("long").alias("_one"))
    up_to = Window.partitionBy(*at).orderBy("_v", F.desc("_one")).rowsBetween(Window.unboundedPreceding, 0)
    counted = numbers.unionByName(wanted).withColumn("_c", F.sum("_one").over(up_to)).where("_one = 0")
    return direct.unionByName(counted.select("_ask.*", (F.col("_v") + F.col("_held") + F.col("_c")).cast(kind).alias(name)))


def _before(x: Column, value, descending: bool) -> Column:
    """Whether x comes before the value, where both are numbers that can be compared."""
    value = value if isinstance(value, Column) else F.lit(value)
    return x > value if descending else x < value


def _nth_value(rows: DataFrame, name: str, descending: bool, n: int, total: int):
    """(the n-th value of a column without nulls and NaN, from 1; how many rows come before it; how many are equal).

    Each round takes two bounds from a sketch around the wanted share and counts exactly what lies before and between them; the last
    few rows between the bounds are put in order on the driver.
    """
    x, low, high, passed = F.col(name), None, None, 0  # candidates: low <= x <= high
    inside, size = rows, total
    while size > EDGE:
        share = (n - passed) / size
        share = 1 - share if descending else share
        marks = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
        a, b = inside.agg(F.percentile_approx(x, marks, 20_000).alias("q")).first()["q"]
        if a == b or (a, b) == (low, high):
            less, equal, more = inside.agg(F.count_if(x < F.lit(a)), F.count_if(x == F.lit(a)), F.count_if(x > F.lit(a))).first()
            ahead = more if descending else less
            if passed + ahead < n <= passed + ahead + equal:
                return a, passed + ahead, equal
            if n <= passed + ahead:
                inside, size = inside.where(_before(x, a, descending)), ahead
            else:
                inside, passed, size = inside.where(_before(x, a, not descending)), passed + ahead + equal, size - ahead - equal
            low = high = None
            continue
        less, within = inside.agg(F.count_if(x < F.lit(a)), F.count_if((x >= F.lit(a)) & (x <= F.lit(b)))).first()
        ahead = size - less - within if descending else less
        if n <= passed + ahead:
            inside, size = inside.where(x > F.lit(b) if descending else x < F.lit(a)), ahead
        elif n <= passed + ahead + within:
            inside, passed, size, low, high = inside.where((x >= F.lit(a)) & (x <= F.lit(b))), passed + ahead, within, a, b
        else:
            inside, passed, size = inside.where(x < F.lit(a) if descending else x > F.lit(b)), passed + ahead + within, size - ahead - within
    values = sorted((r[0] for r in inside.select(name).collect()), reverse=descending)
    value = values[n - passed - 1]
    return value, passed + values.index(value), values.count(value)


def first_rows(rows: DataFrame, order: Sequence[tuple[Column, bool]], n: int) -> DataFrame:
    """The first n rows in the order of numeric columns (and whether they descend) that no two rows share as a whole.

    The value of the n-th row is found column by column; the rows are then filtered by it where they are, so no task
    puts n rows in order. Nulls come first in an ascending column and last in a descending one, NaN is the largest number.
    Rows that are equal in all columns stay or go together.
    """
    kind = lambda c: F.when(c.isNull(), 0).when(F.isnan(c.cast("double")), 2).otherwise(1)
    total = rows.count()
    if n >= total:
        return rows
    if n <= 0:
        return rows.where(F.lit(False))
    chosen, tied = F.lit(False), F.lit(True)
    for c, down in order:
        keys = materialised(rows.where(tied).select(kind(c).alias("k"), c.alias("x")))  # of this column alone; seldom are many rows tied at the next
        counts = {r[0]: r[1] for r in keys.groupBy("k").count().collect()}  # three kinds at most
        for which in sorted(counts, reverse=down):
            if n <= counts[which]:
                break
            n -= counts[which]
        equal = counts[which]
        if len(counts) > 1:
            chosen, tied = chosen | (tied & _before(kind(c), which, down)), tied & (kind(c) == F.lit(which))
        if n < equal and which == 1:
            value, ahead, equal = _nth_value(keys.where("k = 1"), "x", down, n, equal)
            n -= ahead
            if n == equal:  # the columns may be dear, so each is looked at once if that will do
                return rows.where(chosen | (tied & ~_before(F.lit(value), c, down)))
            chosen, tied = chosen | (tied & _before(c, value, down)), tied & (c == F.lit(value))
        if n == equal:
            break
    return rows.where(chosen | tied)


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

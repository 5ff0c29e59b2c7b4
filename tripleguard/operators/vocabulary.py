"""Dense ids of names in the order in which they are first read, and both directions of their join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.session import materialised


def dense_ids(rows: DataFrame, order: str | Sequence[str], keep: Sequence[str] | None = None, ties: Sequence[Column] = ()) -> DataFrame:
    """rows with id 0.. in the order of one or more columns, without a window over the whole table.

    A range shuffle sorts the rows; each part's ids start where the parts before it end. Only one count a part
    is put in order in one task. keep: the columns that go on (all, if none). ties: what sorts rows that are equal in the order.
    """
    parts, by = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [order] if isinstance(order, str) else list(order)
    placed = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by, *ties).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select(*(rows.columns if keep is None else keep), "_at")
    placed = placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    placed = materialised(placed)  # the bounds of a range shuffle differ from one evaluation to the next
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("id", F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with a column for each entry of sums (name: column): its sum over the rows up to this one in the order, which no two rows may share.

    A range shuffle sorts the rows; each part sums its own and adds what the parts before it hold, one row a part.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(f"_of_{name}") for name, c in sums.items()))
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_of_{name}").over(before), F.lit(0)).alias(f"_to_{name}") for name in sums))
    summed = placed.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}).join(F.broadcast(starts), "_part")
    return summed.withColumns({name: F.col(name) + F.col(f"_to_{name}") for name in sums}).drop("_part", *(f"_to_{name}" for name in sums))


def entity_vocabulary(triples: DataFrame) -> DataFrame:
    """(name, id) of heads and tails, the head of a row before its tail."""
    # unfolded, not read twice, as the names may be dear to make
    seen = triples.select("pos", F.posexplode(F.array("h", "t")).alias("end", "name")).select("name", (2 * F.col("pos") + F.col("end")).alias("at"))
    return dense_ids(seen.groupBy("name").agg(F.min("at").alias("at")), "at").select("name", "id")


def relation_vocabulary(triples: DataFrame) -> DataFrame:
    return dense_ids(triples.groupBy(F.col("r").alias("name")).agg(F.min("pos").alias("at")), "at").select("name", "id")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Names to ids; rows with an unknown name go (count_lost() tells how many)."""
    named = lambda v, c: v.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id"))
    rest = [c for c in triples.columns if c not in ("h", "r", "t")]
    return (
        triples.join(named(relations, "r"), "r").drop("r").join(named(entities, "h"), "h").drop("h").join(named(entities, "t"), "t")
        .select(*rest, F.col("h_id").alias("h"), F.col("r_id").alias("r"), F.col("t_id").alias("t"))
    )


def decode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ids to names."""
    swapped = lambda v: v.select(F.col("id").alias("name"), F.col("name").alias("id"))
    return encode(triples, swapped(entities), swapped(relations))


def count_lost(triples: DataFrame, encoded: DataFrame) -> int:
    """Rows that encode() has dropped; 0 unless a name is unknown."""
    return triples.count() - encoded.count()


def bridge(ids: DataFrame, key: str, own: DataFrame, other: DataFrame) -> DataFrame:
    """Ids of one vocabulary to those of another through the name."""
    return ids.join(own.select(F.col("id").alias(key), "name"), key).join(other.select("name", F.col("id").alias(f"{key}_other")), "name")

"""A graph from the tables of a star schema: six kinds of facts from seven tables, with nations and regions as hubs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.operators.vocabulary import dense_ids


def star_graph(spark: SparkSession, folder: str) -> DataFrame:
    """pos, h, r, t: customer placed order, order contains part, order shipped_by supplier, customer and supplier in nation, nation in region.

    Positions are the places in the order of kind, key of the row and ends, as rows of one key occur; each table is scanned for the columns
    of its facts alone. A fact with a null end is left out.
    """
    table = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    line, alone = F.col("l_linenumber").cast("int"), F.lit(0)
    kinds = [
        (table("orders"), "o_orderkey", alone, "c", "o_custkey", "placed", "o", "o_orderkey"),
        (table("lineitem"), "l_orderkey", line, "o", "l_orderkey", "contains", "p", "l_partkey"),
        (table("lineitem"), "l_orderkey", line, "o", "l_orderkey", "shipped_by", "s", "l_suppkey"),
        (table("customer"), "c_custkey", alone, "c", "c_custkey", "in", "n", "c_nationkey"),
        (table("supplier"), "s_suppkey", alone, "s", "s_suppkey", "in", "n", "s_nationkey"),
        (table("nation"), "n_nationkey", alone, "n", "n_nationkey", "in", "g", "n_regionkey"),
    ]
    # keys are put in order as numbers; the names are made behind that
    number = lambda key, c: F.col(key).cast("long").alias(c)
    parts = [rows.select(F.lit(i).cast("byte").alias("kind"), number(a, "a"), b.alias("b"), number(h, "x"), number(t, "y")) for i, (rows, a, b, _, h, _, _, t) in enumerate(kinds)]
    facts = reduce(DataFrame.unionByName, parts).where("x is not null and y is not null")
    placed = dense_ids(facts, ["kind", "a", "b"], ["kind", "x", "y"], [F.col(c).cast("string") for c in ("x", "y")])
    of_kind = lambda i: F.get(F.array(*(F.lit(k[i]) for k in kinds)), F.col("kind").cast("int"))
    return placed.select(F.col("id").alias("pos"), F.concat(of_kind(3), F.col("x").cast("string")).alias("h"), of_kind(5).alias("r"), F.concat(of_kind(6), F.col("y").cast("string")).alias("t"))

"""Connected components of a link table, by repeated contraction. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import remove, written


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node that links reach from node.

    Only nodes with a link to another node appear; self links, null ends and repeated
    links are ignored. Each round points every node at its smallest neighbour, follows the
    pointers once more and replaces each link by the link of its ends' targets, which keeps
    a connected part connected. The smallest node of a component never moves, so the last
    target is that node. Rounds grow with the logarithm of the longest
    chain of pointers. Nothing is gathered on the driver except one count a round; every round
    is written to the shared folder.
    """
    spark = links.sparkSession
    edges, edges_at = written(
        links.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .distinct()
    )
    labels, labels_at = None, None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pointer = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        up = pointer.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        pointer, pointer_at = written(pointer.join(up, "p").select("u", F.col("pp").alias("p")))
        at_u = pointer.select("u", F.col("p").alias("pu"))
        at_v = pointer.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        new_edges, new_edges_at = written(
            edges.join(at_u, "u")
            .join(at_v, "v")
            .where(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct()
        )
        if labels is None:
            new_labels, new_labels_at = written(pointer.select(F.col("u").alias("node"), F.col("p").alias("component")))
        else:
            new_labels, new_labels_at = written(
                labels.join(pointer.select(F.col("u").alias("component"), "p"), "component", "left").select(
                    "node", F.coalesce("p", "component").alias("component")
                )
            )
            remove(spark, labels_at)
        remove(spark, edges_at)
        remove(spark, pointer_at)
        edges, edges_at, labels, labels_at = new_edges, new_edges_at, new_labels, new_labels_at
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels

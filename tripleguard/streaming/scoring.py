"""Scores arriving triples against fixed vectors, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleguard.functions.vectors import translation_score


def scored(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """triples (a stream or a table) with score; entities and relations: id, vec."""
    side = lambda v, c: v.select(F.col("id").alias(c), F.col("vec").alias(f"vec_{c}"))
    joined = triples.join(side(entities, "h"), "h").join(side(relations, "r"), "r").join(side(entities, "t"), "t")
    return joined.withColumn("score", translation_score(F.col("vec_h"), F.col("vec_r"), F.col("vec_t"))).drop("vec_h", "vec_r", "vec_t")


def write_scores(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends scored triples; a restart goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

"""Losses of training batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.functions.vectors import log_softmax


def batch_losses(pairs: DataFrame, gamma: float = 0.5) -> DataFrame:
    """For each batch: mean losses of positives and negatives (halved), the parts of the loss and their total.

    pairs: batch_id and, for positives and (with _neg behind the name) their negatives, translation, second, gap_a, gap_b and similar.
    The parts are the margin between the scores of a pair, the divergence of the second view's score from the first view's, for
    positives and negatives, and the mean distances of the views.
    """
    batch = Window.partitionBy("batch_id")

    def score(end: str) -> Column:
        return F.col(f"translation{end}") + F.col(f"gap_a{end}") + F.col(f"gap_b{end}")

    logs = {f"{c}{end}_log": log_softmax(F.col(f"{c}{end}"), batch) for c in ("translation", "second") for end in ("", "_neg")}

    def divergence(end: str) -> Column:
        p, q = F.col(f"translation{end}_log"), F.col(f"second{end}_log")
        return F.avg(F.exp(p) * (p - q))

    parts = pairs.withColumns(logs).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(score("")) / 2).alias("pos_loss"), (F.avg(score("_neg")) / 2).alias("neg_loss"),
        F.avg(F.greatest(F.lit(0.0), score("") - score("_neg") + gamma)).alias("margin"), divergence("").alias("kl_pos"), divergence("_neg").alias("kl_neg"),
        F.avg("similar").alias("similar_pos"), F.avg("similar_neg").alias("similar_neg"),
    )
    return parts.withColumn("total", sum((F.col(c) for c in ("kl_pos", "kl_neg", "similar_pos", "similar_neg")), F.col("margin")))

"""Ranking of scored triples and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleguard.operators.scan import first_rows
from tripleguard.operators.vocabulary import running_sums


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """rk (from 1), id, score, label of the k largest scores; ties go to the smaller id."""
    best = first_rows(scores, [(F.col("score"), True), (F.col("id"), False)], k)
    ranked = running_sums(best.withColumn("_one", F.lit(1).cast("bigint")), [F.desc("score"), F.col("id")], {"rk": "_one"})
    return ranked.where(F.col("rk") <= k).select("rk", *best.columns)


def discovered(ranked: DataFrame, n_anomalies: int) -> DataFrame:
    """ranked with found, precision and recall at each rank."""
    summed = running_sums(ranked.withColumn("_one", F.col("label").cast("bigint")), [F.col("rk")], {"found": "_one"}).drop("_one")
    return summed.withColumns({"precision": F.col("found") / F.col("rk"), "recall": F.col("found") / F.lit(float(n_anomalies))})


def every_tenth(curve: DataFrame, n: int) -> DataFrame:
    """Ranks 1, 11, 21, ... of a curve of n ranks: n // 10 of them."""
    return curve.where(((F.col("rk") - 1) % 10 == 0) & (F.floor((F.col("rk") - 1) / 10) < n // 10))


def at_ratios(curve: DataFrame, ratios: list[float], n_original: int) -> DataFrame:
    """ratio, k = floor(ratio * n_original), and precision and recall there; null at k = 0 and beyond the curve."""
    rows = [(r, int(r * n_original + 1e-9)) for r in ratios]
    table = curve.sparkSession.createDataFrame(rows, "ratio double, k long")
    wanted = curve.where(F.col("rk").isin([k for _, k in rows])).select(F.col("rk").alias("k"), "precision", "recall")  # a rank for each ratio at most
    return table.join(wanted, "k", "left").select("ratio", "k", "precision", "recall")


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row auc: ties count half; null with one class only. Works on one row for each distinct score."""
    by_score = scores.groupBy("score").agg(F.sum(F.col("label").cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    # negatives with a smaller score
    summed = running_sums(by_score.withColumn("neg", F.col("n") - F.col("p")), [F.col("score")], {"upto": "neg"})
    ranked = summed.withColumn("less", F.col("upto") - F.col("neg"))
    won = F.sum(F.col("p") * (F.col("less") + (F.col("n") - F.col("p")) / 2))
    n1, n0 = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    return ranked.agg(F.when((n1 > 0) & (n0 > 0), won / (n1 * n0)).alias("auc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row ap: the sum of precision times the gain of recall over the distinct scores, from the largest."""
    by_score = scores.groupBy("score").agg(F.sum(F.col("label").cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    summed = running_sums(by_score, [F.desc("score")], {"tp": "p", "k": "n"})
    return summed.agg(F.when(F.sum("p") > 0, F.sum(F.col("p") * F.col("tp") / F.col("k")) / F.sum("p")).alias("ap"))


def intervals(ranked: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Rows of the ranges of 0-based positions, with interval (number) and its cell in a grid five wide."""
    at = F.col("rk") - 1
    case = F.coalesce(*(F.when((at >= lo) & (at < hi), F.lit(i)) for i, (lo, hi) in enumerate(bounds)))
    return ranked.withColumn("interval", case).where("interval is not null").withColumns({"grid_row": F.floor(F.col("interval") / 5), "grid_column": F.col("interval") % 5})


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """rows with scaled: the column moved to 0..1; null where all values are equal."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    lo, hi = ends.first()
    return rows.withColumn("scaled", (F.col(column) - F.lit(lo)) / F.nullif(F.lit(hi) - F.lit(lo), F.lit(0)) if lo is not None else F.lit(None).cast("double"))

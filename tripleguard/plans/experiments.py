"""Tables over the records of many runs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ("dataset", "neg_source", "test_anomaly_source", "anomaly_ratio")


def label(model: str, neg_source: str, test_source: str, seed: int) -> str:
    return f"{model}_{neg_source}x{test_source}_s{seed}"


def matrix(spark: SparkSession, neg_sources: list[str], test_sources: list[str], seeds: list[int], model: str = "encoder") -> DataFrame:
    """neg_source, test_anomaly_source, seed, label of each run of an experiment."""
    rows = [(n, t, s, label(model, n, t, s)) for n, t, s in product(neg_sources, test_sources, seeds)]
    return spark.createDataFrame(rows, "neg_source string, test_anomaly_source string, seed long, label string")


def cutoffs(ratio: float) -> list[float]:
    """Five ratios up to the given one."""
    return [round(ratio * i / 5, 6) for i in range(1, 6)]


def aggregate(records: DataFrame, dataset: str | None = None) -> DataFrame:
    """A row for each cell and metric: runs, mean, population deviation (null for one run) and text.

    records: the columns of CELL, seed, auc, auprc, precision_at and recall_at (maps by cutoff).
    """
    if dataset is not None:
        records = records.where(F.col("dataset") == dataset)
    maps = [records.select(*CELL, F.explode(m).alias("k", "value")).select(*CELL, F.concat(F.lit(f"{m}:"), "k").alias("metric"), "value") for m in ("precision_at", "recall_at")]
    single = [records.select(*CELL, F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("auc", "auprc")]
    rows = maps[0].unionByName(maps[1]).unionByName(single[0]).unionByName(single[1])
    summed = rows.groupBy(*CELL, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    std = F.when(F.col("n") > 1, F.col("std"))
    text = F.when(F.col("n") == 0, "--").when(F.col("n") == 1, F.format_string("%.4f", "mean")).otherwise(F.format_string("%.4f±%.3f", "mean", "std"))
    return summed.withColumns({"text": text}).withColumn("std", std)


def cells(records: DataFrame) -> DataFrame:
    """A row for each cell: runs, its seeds in order (each once) and the cutoffs, by size, of the record with the smallest seed."""
    sized = F.array_sort(F.transform(F.map_keys("precision_at"), lambda k: F.struct(k.cast("double").alias("size"), k.alias("k"))))
    keys = F.transform(sized, lambda x: x["k"])
    return records.withColumn("ks", keys).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.min_by("ks", "seed").alias("ks"))

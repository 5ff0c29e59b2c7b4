"""Logs, run records and requirement lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.sources.triples import read_lines

RECORD = (
    "dataset string, model string, seed long, neg_source string, test_anomaly_source string, anomaly_ratio double, max_epoch long, "
    "precision_at map<string,double>, recall_at map<string,double>, auc double, auprc double, _corrupt_record string"
)


# The lines of a log that other tools read.
METRIC = r"(Precision|Recall)\s+(\d+\.\d+)\s*--\s*(\d+\.\d+)\s*:\s*(\d+\.\d+)"
DURATION = r"Duration:\s+([\d.]+)"
AREAS = r"AUC\s+([\d.]+)\s*--\s*AUPRC\s+([\d.]+)"


def metric_line(where: str, metric: str, ratio: float, k: float, value: float) -> str:
    return f"[Test]{where} {metric} {ratio:f} -- {k:f} : {value:f}"


def areas_line(where: str, auc: float, auprc: float) -> str:
    return f"[Test]{where} AUC {auc:f} -- AUPRC {auprc:f}"


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """The run records below a folder; files that can't be read are left out."""
    reader = spark.read.schema(RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "{*_run.json,part-*.json}").option("multiLine", True).option("mode", "PERMISSIVE")
    return reader.json(root).where("_corrupt_record is null and dataset is not null").drop("_corrupt_record")


def write_records(records: DataFrame, path: str) -> None:
    records.coalesce(1).write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Writes id, score, label in place of what is there."""
    scores.select("id", F.col("score").cast("double"), F.col("label").cast("int")).write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, score double, label int").parquet(path)


def write_duration(spark: SparkSession, path: str, what: str, seconds: float, append: bool = False) -> None:
    """A line with the seconds that something took, in place of the lines there or (append) behind them; total_minutes() reads it."""
    line = spark.createDataFrame([(f"{what}, Duration: {seconds:f} seconds",)], "value string")
    line.coalesce(1).write.mode("append" if append else "overwrite").text(path)


def write_log(spark: SparkSession, path: str, lines: list[str], append: bool = True) -> None:
    """Puts the few lines that a run has to say behind what the log holds; read_log() gives them in the order of writing."""
    rows = spark.createDataFrame([(line,) for line in lines], "value string")
    rows.coalesce(1).write.mode("append" if append else "overwrite").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """at, value: the lines of a log that was written in parts, from the first to the last."""
    return read_lines(spark, path, by="time")


def matches(lines: DataFrame, pattern: str, *groups: int) -> DataFrame:
    """at (line and number of the match in it) and g1, g2, ...: every match of a pattern in lines (at, value)."""
    found = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(pattern), F.lit(g)).alias(f"g{i + 1}") for i, g in enumerate(groups)))
    rows = lines.select("at", F.posexplode(found).alias("no", "m"))
    return rows.select(F.struct("at", "no").alias("at"), *(F.col(f"m.g{i + 1}").alias(f"g{i + 1}") for i in range(len(groups))))


def last_value(lines: DataFrame, pattern: str, key: int, value: int) -> DataFrame:
    """key, value of the pattern's groups; for each key the match read last. lines: at, value."""
    return matches(lines, pattern, key, value).where("g2 != ''").groupBy(F.col("g1").alias("key")).agg(F.max_by("g2", "at").cast("double").alias("value"))


def first_value(lines: DataFrame, pattern: str, group: int) -> DataFrame:
    """One row: the group in the first match; null if there is none."""
    return matches(lines, pattern, group).where("g1 != ''").agg(F.min_by("g1", "at").cast("double").alias("value"))


def total_minutes(lines: DataFrame, pattern: str, group: int) -> DataFrame:
    """One row: minutes (null if there is none) and how many durations in seconds were found."""
    found = F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(group))).alias("v")
    got = lines.select(found).where("v != ''").select(F.col("v").cast("double").alias("s"))
    return got.agg((F.sum("s") / 60).alias("minutes"), F.count("s").alias("n"))


def near(a: Column, b: Column | float, tolerance: float = 1e-4) -> Column:
    return F.abs(a - b) < tolerance


def metrics_at(lines: DataFrame, ratio: float) -> DataFrame:
    """k, precision, recall of the log lines whose anomaly ratio is near the given one; of several, the line read last. lines: at, value."""
    found = matches(lines, METRIC, 1, 2, 3, 4)
    got = found.select("at", F.col("g1").alias("metric"), F.col("g2").cast("double").alias("ratio"), F.round(F.col("g3").cast("double"), 6).alias("k"), F.col("g4").cast("double").alias("v"))
    kept = got.where(near(F.col("ratio"), ratio))
    last = lambda name: F.max_by(F.when(F.col("metric") == name, F.col("v")), F.when(F.col("metric") == name, F.col("at"))).alias(name.lower())
    return kept.groupBy("k").agg(last("Precision"), last("Recall"))


def requirement(line):
    """`name version` as `name==version`; a line of one field is trimmed."""
    return F.regexp_replace(F.trim(line), r"^(\S+)\s+(\S.*)$", "$1==$2")


def rewrite_requirements(spark: SparkSession, source: str, target: str) -> None:
    """Writes the lines of a requirement list as requirement() has them, in their order, to another path; empty lines go."""
    lines = read_lines(spark, source).where(F.trim("value") != "").select("at", requirement(F.col("value")).alias("value"))
    lines.orderBy("at").select("value").write.mode("overwrite").text(target)

"""The runs of an experiment's matrix as cells of a ledger: each is run until it is done once, and what happened is kept.

Outcomes are rows that are only ever added: label, status (done or failed), error, seconds and when. A cell is done if one of
its outcomes says so, so a restart runs what has failed or never ended, and nothing twice. Cells run side by side, each in a
scheduler pool of its own, so that one large cell doesn't hold the others back.
"""

from __future__ import annotations

import argparse
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.plans import experiments, runs
from tripleguard.session import exists
from tripleguard.sources import records

OUTCOME = "label string, status string, error string, seconds double, at double"


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """All outcomes so far; none if there is no ledger."""
    return spark.read.schema(OUTCOME).option("recursiveFileLookup", True).json(path) if exists(spark, path) else spark.createDataFrame([], OUTCOME)


def latest(outcomes: DataFrame) -> DataFrame:
    """label, status, error, tries and seconds (of all tries) of each cell: the last outcome, but done once is done."""
    when = F.struct((F.col("status") == "done").alias("done"), "at")
    return outcomes.groupBy("label").agg(F.max_by("status", when).alias("status"), F.max_by("error", when).alias("error"), F.count(F.lit(1)).alias("tries"), F.sum("seconds").alias("seconds"))


def unfinished(cells: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The cells (label and more) that aren't done."""
    return cells.join(latest(outcomes).where("status = 'done'").select("label"), "label", "left_anti")


def note(spark: SparkSession, path: str, label: str, status: str, error: str | None, seconds: float) -> None:
    """Adds an outcome, in a folder of its own: writers that end at once can't disturb each other."""
    row = spark.createDataFrame([(label, status, error, seconds, time.time())], OUTCOME)
    row.coalesce(1).write.json(f"{path}/{uuid.uuid4().hex}")


def run_cells(spark: SparkSession, cells: DataFrame, one: Callable[[dict], object], path: str, side_by_side: int = 2) -> DataFrame:
    """Runs one(cell) for every cell that isn't done, and returns the ledger; a failure is written down and stops no other cell.

    cells: label and what one() needs; an experiment's matrix, not data. A cell must be safe to run again.
    """

    def attempt(place: int, cell: dict) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cell-{place % side_by_side}")
        began = time.time()
        try:
            one(cell)
        except Exception as problem:  # whatever it is, it goes into the ledger
            note(spark, path, cell["label"], "failed", f"{type(problem).__name__}: {problem}"[:2000], time.time() - began)
        else:
            note(spark, path, cell["label"], "done", None, time.time() - began)
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    todo = [r.asDict() for r in unfinished(cells, read_outcomes(spark, path)).orderBy("label").collect()]
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        list(pool.map(inheritable_thread_target(spark)(attempt), range(len(todo)), todo))
    return latest(read_outcomes(spark, path))


def run_matrix(spark: SparkSession, base: runs.Config, neg_sources: list[str], test_sources: list[str], seeds: list[int], side_by_side: int = 2, evaluate: Callable = runs.evaluate) -> tuple[DataFrame, DataFrame]:
    """(ledger, aggregate over the seeds of what is done) of all combinations; frozen anomalies are shared by the cells of a test source and seed."""
    cells = experiments.matrix(spark, neg_sources, test_sources, seeds, base.model)

    def one(cell: dict) -> None:
        frozen = f"{base.output}/anomalies_{cell['test_anomaly_source']}_s{cell['seed']}"
        evaluate(spark, replace(base, neg_source=cell["neg_source"], test_anomaly_source=cell["test_anomaly_source"], seed=cell["seed"], anomaly_file=frozen))

    # cells that share frozen anomalies but have none yet are run one at a time
    first = cells.where(F.col("neg_source") == neg_sources[0])
    ledger = run_cells(spark, first, one, f"{base.output}/ledger", side_by_side)
    if len(neg_sources) > 1:
        ledger = run_cells(spark, cells, one, f"{base.output}/ledger", side_by_side)
    return ledger, report(spark, base.output, base.dataset)


def report(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    """A row for each cell and metric of the records below the root: the cutoffs are those of the record with the smallest seed, `--` stands for what no run has."""
    found = records.read_records(spark, root)
    named = experiments.cells(found).select(*experiments.CELL, F.array_join("seeds", ",").alias("seeds"), "ks")
    k = F.split("metric", ":")
    wanted = (F.size(k) == 1) | F.array_contains("ks", F.get(k, F.lit(1)))
    return experiments.aggregate(found, dataset).join(named, list(experiments.CELL)).where(wanted).select(*experiments.CELL, "seeds", "metric", "n", "mean", "std", F.coalesce("text", F.lit("--")).alias("text"))


def main(arguments: Iterable[str] | None = None) -> int:
    """spark-submit ledger.py --data DIR --output DIR --neg_sources random,generator --test_sources random --seeds 0,1: 1 if a cell has failed."""
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("data", "output"):
        parser.add_argument(f"--{name}", required=True)
    for name, default in (("neg_sources", "random"), ("test_sources", "random"), ("seeds", "0"), ("side_by_side", "2"), ("model", "translation"), ("dataset", "graph"), ("max_epoch", "1"), ("anomaly_ratio", "0.05")):
        parser.add_argument(f"--{name}", default=default)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    fields = {name: runs.typed(name, getattr(given, name)) for name in ("data", "output", "model", "dataset", "max_epoch", "anomaly_ratio")}
    seeds = [int(s) for s in given.seeds.split(",")]
    ledger, table = run_matrix(spark, runs.from_session(spark, **fields), given.neg_sources.split(","), given.test_sources.split(","), seeds, int(given.side_by_side))
    table.orderBy(*experiments.CELL, "metric").show(1000, truncate=False)
    return int(not ledger.where("status != 'done'").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())

"""One run of an experiment: anomalies put into a graph, every triple scored, and the scores, times and record written."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.operators import corrupt, encoder, graph, vocabulary
from tripleguard.plans import experiments, optimiser, ranking
from tripleguard.session import exists, materialised
from tripleguard.sources import negatives, records, triples


@dataclass(frozen=True)
class Config:
    """What a run depends on; `tripleguard.<name>` in the session's configuration sets a field."""

    data: str = ""
    output: str = ""
    dataset: str = "graph"
    model: str = "encoder"
    seed: int = 0
    anomaly_ratio: float = 0.05
    neg_source: str = "random"
    test_anomaly_source: str = "random"
    anomaly_file: str | None = None
    weights: str | None = None
    neighbours: int = 39
    dim: int = 100
    hidden: int = 100
    alpha: float = 0.2
    mu: float = 0.001
    weight: float = 0.1
    max_epoch: int = 1
    mode: str = "both"
    batch: int = 256
    rate: float = 0.003
    gamma: float = 0.5
    entity_vectors: str | None = None
    relation_vectors: str | None = None

    @property
    def label(self) -> str:
        return experiments.label(self.model, self.neg_source, self.test_anomaly_source, self.seed)


def typed(name: str, text: str) -> str | int | float:
    """The text as a value of the field's type."""
    kind = {f.name: str(f.type) for f in fields(Config)}[name]
    return int(text) if kind == "int" else float(text) if kind == "float" else text


def from_session(spark: SparkSession, **given: str | int | float | None) -> Config:
    """The configuration that the session's settings give; what is given here goes before them."""
    found = {f.name: spark.conf.get(f"tripleguard.{f.name}", None) for f in fields(Config)}
    return Config(**{name: typed(name, text) for name, text in found.items() if text is not None} | given)


def vectors_of(spark: SparkSession, entities: DataFrame, relations: DataFrame, config: Config) -> list[DataFrame]:
    """id, vector of entities and of relations from the files that config names, or None where it names none."""
    given = zip((entities, relations), (config.entity_vectors, config.relation_vectors))
    return [triples.vectors_for(v, triples.read_vectors(spark, path)).select("id", "vector") if path else None for v, path in given]


def training_pairs(labelled: DataFrame, rows: DataFrame, sizes: tuple[int, int], config: Config, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pos, h, r, t, h2, r2, t2: one negative for each original and anomaly, from the source that config names; where it gives none, a random one."""
    known, seed = rows.select("h", "r", "t").distinct(), str(config.seed)
    fallback = corrupt.single_slot(labelled, known, *sizes, seed)
    if config.neg_source == "generator":
        made = generate(labelled) if generate else negatives.type_pool_negatives(labelled, known, seed)
        fallback = corrupt.replaced(made.select("pos", *(F.col(c).alias(f"{c}2") for c in "hrt")), fallback)
    elif config.neg_source != "random":
        raise ValueError(f"unknown source of negatives: {config.neg_source}")
    return labelled.select("pos", "h", "r", "t").join(fallback.select("pos", *(F.col(c).alias(f"{c}2") for c in "hrt")), "pos")


def trained_state(labelled: DataFrame, rows: DataFrame, entities: DataFrame, relations: DataFrame, config: Config, here: str, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The vectors after max_epoch epochs of training below here, or what is left of them; in mode test they must be there."""
    spark = labelled.sparkSession
    if config.mode == "test":
        if not exists(spark, f"{here}_state/loss-{config.max_epoch}/_SUCCESS"):
            raise FileNotFoundError(f"{here}_state has no epoch {config.max_epoch}: train first")
        return optimiser.read_state(spark, f"{here}_state", config.max_epoch)
    given, seed = vectors_of(spark, entities, relations, config), str(config.seed)
    start = optimiser.initial_state(entities, relations, config.dim, seed)
    if all(given):
        start = optimiser.given_state(*given)
    pairs = materialised(training_pairs(labelled, rows, (entities.count(), relations.count()), config, generate))

    if config.neg_source == "generator":
        records.write_log(spark, f"{here}_log", negatives.told(pairs, rows, entities, relations))

    def told(epoch: int, loss: float | None, seconds: float) -> None:
        records.write_duration(spark, f"{here}_epoch_times", f"Epoch: {epoch}", seconds, append=True)
        records.write_log(spark, f"{here}_log", [f"Epoch: {epoch}, loss {loss}"])

    dim = start.agg(F.max(F.size("x"))).first()[0] or config.dim
    return optimiser.train(pairs, start, f"{here}_state", config.max_epoch, dim, config.batch, seed, config.rate, config.gamma, told=told)


def scores(labelled: DataFrame, rows: DataFrame, entities: DataFrame, relations: DataFrame, config: Config, weights: encoder.Weights) -> DataFrame:
    """id, score, label of labelled triples (pos, h, r, t, label) by the encoder; neighbours come from the triples of rows."""
    drawn = [encoder.initial_vectors(v, config.dim, kind, str(config.seed)) for v, kind in ((entities, "ent"), (relations, "rel"))]
    given = vectors_of(labelled.sparkSession, entities, relations, config)
    vectors = [d if g is None else g.select("id", F.col("vector").alias("va"), F.col("vector").alias("vb")) for d, g in zip(drawn, given)]
    found = encoder.anomaly_scores(encoder.attend_rows(labelled, rows, *vectors, weights, config.neighbours, str(config.seed), config.alpha, config.mu, config.weight))
    return found.join(labelled.select("pos", "label"), "pos").select(F.col("pos").alias("id"), "score", "label")


def evaluate(spark: SparkSession, config: Config, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs config and returns its record (one row), or in mode train the losses of the epochs; a missing folder or vocabulary name stops it.

    The model translation is trained first; the encoder runs with given or drawn weights. Writes below output: <label>_scores (Parquet: id,
    score, label), <label>_log, <label>_test_time, <label>_run.json, and for a trained model <label>_state and <label>_epoch_times. generate: see negatives.
    """
    began = time.time()
    read, _ = triples.read_triples(spark, config.data)
    entities, relations = vocabulary.entity_vocabulary(read), vocabulary.relation_vocabulary(read)
    rows = materialised(vocabulary.encode(read.select("pos", "h", "r", "t"), entities, relations))
    total = rows.count()
    wanted = int(config.anomaly_ratio * total + 1e-9)
    planted = materialised(negatives.anomalies(spark, config.test_anomaly_source, wanted, rows, entities, relations, str(config.seed), config.data, generate, config.anomaly_file))
    # numbered by value, so that a frozen set gets the same positions, and with them the same neighbours, in every run
    copies = planted.groupBy("h", "r", "t").agg(F.count(F.lit(1)).alias("n")).select("h", "r", "t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    behind = (F.lit(len(triples.SPLITS) * triples.FILE_STEP) + F.col("id")).alias("pos")
    numbered = vocabulary.dense_ids(copies.withColumn("_by", F.struct("h", "r", "t", "copy")), "_by")
    labelled = rows.withColumn("label", F.lit(0)).unionByName(numbered.select(behind, "h", "r", "t", F.lit(1).alias("label")))
    here = f"{config.output}/{config.label}"
    labelled = materialised(labelled)
    records.write_log(spark, f"{here}_log", [f"There are {total} Triples with {planted.count()} anomalies in the graph."], append=config.mode == "test")
    if config.model == "translation":
        state = trained_state(labelled, rows, entities, relations, config, here, generate)
        if config.mode == "train":
            return optimiser.read_losses(spark, f"{here}_state")
        scored = optimiser.distances(labelled, state).join(labelled.select("pos", "label"), "pos").select(F.col("pos").alias("id"), "score", "label")
    else:
        weights = encoder.load_weights(spark, config.weights) if config.weights else encoder.initial_weights(config.dim, config.hidden, config.seed)
        scored = scores(labelled, rows, entities, relations, config, weights)
    records.write_scores(scored, f"{here}_scores")
    found = records.read_scores(spark, f"{here}_scores")
    records.write_duration(spark, f"{here}_test_time", "Test", time.time() - began)
    record = materialised(run_record(found, total, config))
    records.write_log(spark, f"{here}_log", log_lines(record.first(), config))
    records.write_records(record, f"{here}_run.json")
    return record


def log_lines(record, config: Config) -> list[str]:
    """The lines of the log that tell a record's figures: two a cutoff, and the areas."""
    where = f"[{config.dataset}][{config.label}]"
    lines = [records.areas_line(where, record["auc"], record["auprc"])] if record["auc"] is not None and record["auprc"] is not None else []
    for name, metric in (("precision_at", "Precision"), ("recall_at", "Recall")):
        lines += [records.metric_line(where, metric, config.anomaly_ratio, float(k), v) for k, v in sorted(record[name].items(), key=lambda e: float(e[0])) if v is not None]
    return lines


def run_record(found: DataFrame, total: int, config: Config) -> DataFrame:
    """The record of scores: precision and recall at five cutoffs, AUC and average precision; recall is out of the anomalies that were realised."""
    n = found.where("label = 1").count()
    cutoffs = experiments.cutoffs(config.anomaly_ratio)
    curve = ranking.discovered(ranking.top_k(found, 2 * n), n)
    at = ranking.at_ratios(curve, cutoffs, total).select(F.col("ratio").cast("string").alias("k"), "precision", "recall")
    maps = at.agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", c)))).alias(f"{c}_at") for c in ("precision", "recall")))  # a row for each cutoff
    single = ranking.roc_auc(found).join(ranking.average_precision(found).withColumnRenamed("ap", "auprc"))  # a row each
    told = {"dataset": config.dataset, "model": config.label, "seed": config.seed, "neg_source": config.neg_source, "test_anomaly_source": config.test_anomaly_source, "anomaly_ratio": config.anomaly_ratio, "max_epoch": config.max_epoch}
    return maps.join(single).select(*(F.lit(v).alias(c) for c, v in told.items()), "precision_at", "recall_at", "auc", "auprc")


def main() -> None:
    """spark-submit runs.py --data DIR --output DIR ...: a failure is the exit code of the job."""
    parser = argparse.ArgumentParser(description=__doc__)
    for f in fields(Config):
        parser.add_argument(f"--{f.name}")
    given = {name: typed(name, text) for name, text in vars(parser.parse_args()).items() if text is not None}
    spark = SparkSession.builder.getOrCreate()
    evaluate(spark, from_session(spark, **given)).show(truncate=False)


if __name__ == "__main__":
    main()

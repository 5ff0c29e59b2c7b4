"""Corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Defined results on odd rows, for every stage: further columns of documents are dropped, whatever their names; an empty table gives an
empty one; whole texts are read, of any length; null ids and repeated ids are rows like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from tripleguard.llm.queries import RANKS
from tripleguard.llm.shared import read_documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and row_key, which tells rows of one id or of none apart."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row_key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised.

    A text that is null, empty or without a letter has no language and goes; equal rows share their fate.
    """
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes all but the first of similar lines; a document left without any text goes."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.where((F.size("removed") == 0) | (F.trim("text") != "")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, the one of the smallest id stays (a null id comes last); equal rows stay once."""
    rows = _keyed(docs)
    found = ngram_join.components(rows, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    of_key = rows.select("row_key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    keep = found.join(of_key, "row_key").groupBy("component_id").agg(first).select("first.row_key")
    kept = rows.join(keep, "row_key", "left_semi").groupBy("row_key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of a benchmark item.

    A null or empty text holds none and stays; items without words have no window; equal rows share their fate.
    """
    rows = _keyed(docs)
    hits = decontaminate.find_hits(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc_key="row_key")
    return rows.join(hits.select(F.col("doc_key").alias("row_key")).distinct(), "row_key", "left_anti").select(*COLUMNS)


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: one row for each document, repeated rows included; a null or empty text has no tokens."""
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("tokens", count_tokens),
]

#: A learned stage and MinHash are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each reread from what the one before has written."""
    docs = read_documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = written(docs)
    return docs

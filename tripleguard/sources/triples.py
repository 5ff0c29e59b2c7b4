"""Triples, vectors and anomalies as files and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleguard.operators.vocabulary import decode, dense_ids, encode

SPLITS = ("train", "valid", "test")
#: The numbers of a file's lines, which are no larger than its bytes, stay below this.
FILE_STEP = 1 << 60
#: Lines within so many bytes (as a power of two) are put in order together.
SEGMENT = 27


def read_lines(spark: SparkSession, path: str, by: str = "name") -> DataFrame:
    """at, value: the lines of a text file, or of several ones by name or by time, in their order, with growing numbers (not dense).

    A line is numbered by the bytes of the files before its own, the start of its block and its place in that block: no line is
    shorter than a byte, so the numbers of two blocks can't overlap, however Spark packs the blocks into tasks.
    """
    whole = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("time"), F.monotonically_increasing_id().alias("row"))
    blocks = whole.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"), F.first("size").alias("size"), F.first("time").alias("time"))
    # a compressed file is one block, with more lines than bytes perhaps
    files = blocks.groupBy("file").agg(F.greatest(F.max("size"), F.sum("lines")).alias("size"), F.max("time").alias("time"))
    order = Window.orderBy(*(["time"] if by == "time" else []), "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    before = files.select("file", F.coalesce(F.sum(F.col("size") + 1).over(order), F.lit(0)).alias("before"))
    placed = whole.select("value", "file", "block", "row").join(blocks.select("file", "block", "first"), ["file", "block"]).join(before, "file")
    return placed.select((F.col("before") + F.col("block") + F.col("row") - F.col("first")).alias("at"), "value")


def split_triples(lines: DataFrame) -> DataFrame:
    """lines with h, r, t and good: three fields between tabs."""
    fields = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    good = F.size(fields) == 3
    return lines.select("*", *(F.when(good, F.get(fields, i)).alias(c) for i, c in enumerate("hrt")), good.alias("good"))


def read_triples(spark: SparkSession, folder: str, repeat_bad: bool = False) -> tuple[DataFrame, DataFrame]:
    """(triples: pos, split, h, r, t; bad lines: pos, split, value) of the three files of a graph, in order.

    repeat_bad: a malformed line stands for the triple before it, instead of only being set aside.
    """
    parts = [split_triples(read_lines(spark, f"{folder}/{s}.txt")).withColumn("split", F.lit(s)).withColumn("pos", F.col("at") + i * FILE_STEP) for i, s in enumerate(SPLITS)]
    rows = reduce(DataFrame.unionByName, parts)
    bad = rows.where("not good").select("pos", "split", "value")
    good = rows.where("good").select("pos", "split", "h", "r", "t")
    if repeat_bad:
        # the last good line before each line: of its own split, or else of the nearest split before, one row a split
        split_of, named = F.shiftright("pos", SEGMENT), F.when(F.col("good"), F.struct("h", "r", "t"))
        parts = rows.select("pos", "split", "good", split_of.alias("part"), named.alias("x"))
        ends = parts.where("good").groupBy("part").agg(F.max_by("x", "pos").alias("end"))
        every = parts.select("part").distinct().join(ends, "part", "left")
        carried = every.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
        own = F.last("x", ignorenulls=True).over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        filled = parts.withColumn("own", own).join(F.broadcast(carried), "part").where("not good").select("pos", "split", F.coalesce("own", "carried").alias("x"))
        good = good.unionByName(filled.where("x is not null").select("pos", "split", "x.h", "x.r", "x.t"))
    return good, bad


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, vector: a line of numbers between white space each; the id is the number of the line, from 0."""
    return dense_ids(read_lines(spark, path), "at").select("id", F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("float")).alias("vector"))


def vectors_for(vocabulary: DataFrame, vectors: DataFrame) -> DataFrame:
    """id, name, vector of each name; an error if the file has other lines than the vocabulary has ids, or lines of different lengths."""
    names, lines = vocabulary.count(), vectors.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("vector")).alias("sizes")).first()
    if lines["n"] != names or lines["sizes"] > 1:
        raise ValueError(f"{lines['n']} vectors of {lines['sizes']} lengths for {names} names")
    return vocabulary.select("id", "name").join(vectors, "id")


def freeze(anomalies: DataFrame, entities: DataFrame, relations: DataFrame, path: str) -> None:
    """Writes h, r, t as names between tabs, so that later runs meet the same anomalies."""
    decode(anomalies.select("h", "r", "t"), entities, relations).select("h", "r", "t").write.mode("overwrite").option("sep", "\t").csv(path)


def thaw(spark: SparkSession, entities: DataFrame, relations: DataFrame, path: str) -> DataFrame:
    """h, r, t as ids of a frozen set; an unknown name is an error."""
    named = spark.read.schema("h string, r string, t string").option("sep", "\t").csv(path)
    encoded = encode(named, entities, relations)
    if named.count() != encoded.count():
        raise ValueError(f"{path} has names that the vocabulary lacks")
    return encoded


def frozen_or(spark: SparkSession, path: str, entities: DataFrame, relations: DataFrame, make) -> DataFrame:
    """The frozen set at path if there is one; else make() is frozen there and read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        freeze(make(), entities, relations, path)
    return thaw(spark, entities, relations, path)


def events_graph(events: DataFrame) -> DataFrame:
    """pos, h, r, t of the events table: a user, the event's type, and the number in its properties."""
    return events.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("h"), F.col("event_type").alias("r"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("t")
    )

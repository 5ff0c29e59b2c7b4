"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tripleguard.session import CLEAN_UP, scratch


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; see scratch()."""
    return scratch(spark, "llm")


def written(df: DataFrame, codec: str | None = None) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read again, and its place.

    Cuts the lineage; the files outlive any executor. Shuffle files of the write go once it has ended, so
    a chain of such steps needs the disk of its largest one. codec: a compression other than the session's.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for a step that makes much more than it reads."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders made by written() that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes in the given column, so that memory follows size."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

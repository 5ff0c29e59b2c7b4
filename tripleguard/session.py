"""Folders that all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whether Spark removes an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a table up to which in_slices() works on all of it at once.
STEP = 200_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a folder under /tmp serves a single machine; with more of them it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (spark.master is {master!r})")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """df written to the path, or else to a new one in the shared folder, and read again; and where it lies.

    Shuffle files of the write go once it has ended, so a chain of such steps needs the disk of its largest one.
    """
    spark = df.sparkSession
    path, before = path or scratch(spark, "step"), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path, compression="zstd")
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def materialised(df: DataFrame) -> DataFrame:
    """df written in the shared folder and read again: evaluated once, and safe from lost executors."""
    return stored(df)[0]


def in_slices(rows: int, make: Callable[[Callable[..., DataFrame]], DataFrame], step: int | None = None) -> DataFrame:
    """What make() gives for all of the keys, evaluated once: in one go, or for so many rows in slices of about a step each (STEP, if none is given).

    make gets keep(df, *keys), which leaves the rows of a slice of the keys. Shuffle files of a slice go before the next one, so
    that a larger table needs more slices and not more disk for them.
    """
    parts = -(-rows // (step or STEP))
    if parts < 2:
        return materialised(make(lambda df, *keys: df))

    def keep(i: int) -> Callable[..., DataFrame]:
        return lambda df, *keys: df.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == i)

    return reduce(DataFrame.unionByName, [materialised(make(keep(i))) for i in range(parts)])

"""URL filter: a blocked Bloom filter of listed canonical keys in front of an exact hash join.

The list holds keys `host/path`: a host with all its subdomains and a path prefix. Each listed key sets a few
bits in one block of the filter; the filter is a table of blocks that grows with the list. A URL asks for the keys that could
list it (each suffix of its host with each listed path length). Only keys whose bits are
all set reach the exact join, which removes the filter's false positives. Neither join is hinted: Spark picks
how by the size of the list.

Defined results: a null URL, or one without `://`, has an empty host and path and is
allowed; repeated URLs each get their row; an empty list allows everything; an empty table gives an empty
table. Only the two named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleguard.llm.bloom import blocks_for, filter_table, probe

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, ASCII letters lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path prefix)."""
    rows = [(f"{h}{p}", v, len(h) + len(p), len(p)) for v, h, p in rules]
    return spark.createDataFrame(rows, "key string, verdict string, length int, path_length int")


def filter_urls(
    pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules: key, verdict, length, path_length as from listed(); it may be large. The longest key that
    fits wins (equal lengths: the smaller key). rule is null where no key fits; the verdict is then
    the default.
    """
    rules = rules.dropDuplicates(["key", "verdict"])
    n_keys = rules.count()
    n_blocks = blocks_for(n_keys)
    blocks = filter_table(rules, "key", n_blocks)
    lengths = F.array(*(F.lit(r[0]) for r in rules.select("path_length").distinct().collect()) or [F.lit(0)])
    # a longer suffix than the longest listed host can't be listed, so a host of very many labels costs no more
    most = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("n")).first()["n"] or 0
    split = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.slice(F.split("host", r"\."), -max(most, 1), max(most, 1))
    labels = F.when(F.size(F.split("host", r"\.")) > max(most, 1), labels).otherwise(F.split("host", r"\."))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(
                F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.concat(s, F.substring(F.col("path"), F.lit(1), n))
            ),
        )
    )
    asked = split.where(F.col("host") != "").select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(keys)).alias("key"))
    exact = rules.select("key", F.col("verdict").alias("said"), "length")
    found = (
        probe(asked, "key", blocks, n_blocks)
        .join(exact, "key")
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.col("length")).alias("l"), F.col("key").alias("rule"), F.col("said"))).alias("best"))
        .select("host", "path", "best.rule", "best.said")
    )
    return split.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict")
    )

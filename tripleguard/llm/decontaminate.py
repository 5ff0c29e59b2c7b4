"""Benchmark decontamination by a prefix-filtered set join. DataFrame operations only.

A window is window consecutive words of a benchmark item (an item of fewer words is one window). The
shingles of a window, three words each (fewer only in a shorter window), are ordered by how often they
occur in the documents. A text that holds the window holds all its shingles, so the prefix that must be
shared is the rarest one: only it is joined. Its place in the window gives the one start that the
match can have (positional bound), the window must fit the document (length bound), and the words
there are compared one by one.

Defined results: null texts and texts without words have no words and no hits; items without words
have no windows; equal windows of several items count for each of them; repeated document rows each get
their row; an empty benchmark leaves every document clean. Only the named columns are read, so further columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.bloom import likely
from tripleguard.llm.shared import remove, written
from tripleguard.llm.url_filter import LOWER, UPPER

#: Separators: ASCII but for digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3


def words_of(text: Column) -> Column:
    """Words of text, ASCII letters lower-cased; empty for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def windows_of(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item_id, win (its words)."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    return items.select(
        "item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("win")
    ).distinct()


def _shingle_at(words: Column, pos: Column, n: int) -> Column:
    """Hash of n words from pos (0-based); null where they don't fit."""
    return F.when(pos + n <= F.size(words), F.xxhash64(*(F.get(words, pos + i) for i in range(n))))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_key: str = "doc_key", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_key, start, size, item_id: each occurrence of a window of an item in a document, once.

    doc_key tells the documents apart; start is the 0-based word. The plan is one at every size: a Bloom filter spares most
    shingles of the documents the joins, and Spark picks how to join what is left.
    """
    spark = docs.sparkSession
    held, held_at = written(windows_of(benchmark, item_id, item_text, window))
    windows = held.select("win").distinct().withColumn("win_id", F.xxhash64("win"))
    texts = docs.select(F.col(doc_key).alias("doc_key"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    found, done = None, [held_at]
    for n in sorted({min(r[0], SHINGLE) for r in windows.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect()}):
        of_n = windows.where(F.least(F.size("win"), F.lit(SHINGLE)) == n)
        shingles, shingles_at = written(of_n.select("win_id", "win", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("win") - n), lambda i: F.xxhash64(*(F.get(F.col("win"), i + k) for k in range(n))))).alias("offset", "h")))
        rows = texts.select("doc_key", "words", F.posexplode("words").alias("pos", "word")).withColumn("h", _shingle_at(F.col("words"), F.col("pos"), n))
        known = shingles.select("h").distinct()
        counted = likely(rows.select("h"), "h", known, known.count()).groupBy("h").count().join(known, "h")  # counted first, as one shingle may be everywhere
        prefix, prefix_at = written(
            shingles.join(counted, "h")  # a shingle that no document has rules its window out below
            .groupBy("win_id")
            .agg(F.min(F.struct("count", "h", "offset")).alias("rarest"), F.count_distinct("offset").alias("n_known"))
            .select("win_id", "rarest.h", "rarest.offset", "n_known")
            .join(of_n, "win_id")
            .where(F.col("n_known") == F.size("win") - n + 1)
            .select("h", "offset", "win_id", "win")
        )
        # the words around a shingle that a window can cover, so that no whole text is moved
        first = F.greatest(F.lit(0), F.col("pos") - (window - n))
        near = likely(rows, "h", prefix.select("h"), prefix.count()).select("doc_key", "h", (F.col("pos") - first).alias("inside"), first.alias("first"), F.slice("words", first + 1, F.lit(2 * window)).alias("around"))
        at = F.col("inside") - F.col("offset")
        same = F.slice(F.col("around"), at + 1, F.size("win")) == F.col("win")
        hits = near.join(prefix, "h").where((at >= 0) & (at + F.size("win") <= F.size("around"))).where(same)
        hits, hits_at = written(hits.select("doc_key", (F.col("first") + at).alias("start"), "win_id", F.size("win").alias("size")).distinct())
        remove(spark, shingles_at, prefix_at)
        done.append(hits_at)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "doc_key long, start int, size int").withColumn("item_id", F.lit(None).cast(benchmark.schema[item_id].dataType))
    items = held.select("item_id", F.xxhash64("win").alias("win_id"))
    result, _ = written(found.join(items, "win_id").select("doc_key", "start", "size", "item_id"))
    remove(spark, *done)
    return result


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings) for each row of docs."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("doc_key", F.xxhash64("doc_id", "text"))
    hits = find_hits(keyed, benchmark, window, "doc_key", "text", item_id, item_text)
    return keyed.select("doc_id", "doc_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words")).join(
        summary(hits), "doc_key", "left"
    ).select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def summary(hits: DataFrame) -> DataFrame:
    """doc_key, n_hit (words inside any occurrence), n_items, items."""
    spans = hits.groupBy("doc_key", "start").agg(F.max("size").alias("size"))
    starts = F.expr("max(start + size) over (partition by doc_key order by start rows between unbounded preceding and 1 preceding)")
    covered = (
        spans.withColumn("before", F.coalesce(starts, F.lit(0)))
        .groupBy("doc_key")
        .agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", "before"))).alias("n_hit"))
    )
    items = hits.select("doc_key", F.col("item_id").cast("string").alias("item")).groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return covered.join(items, "doc_key").select("doc_key", "n_hit", F.size("items").alias("n_items"), "items")

"""Fuzzy line deduplication by MinHash. DataFrame operations only.

Lines are the parts of a text between line feeds; blank lines are left alone. Equal lines are one
node, named by a 64-bit hash, and are shingled once. A node's signature holds, for each of ROWS * BANDS constants, the
smallest shingle hash combined with the constant by exclusive or, over its windows of SHINGLE
characters (a shorter line is one window). Nodes that agree on one band of a signature are candidates: the node of
most occurrences in a bucket meets the others. Nodes whose buckets still hold different
components then meet by a prefix filter over their shingles, which is exact, so nothing is lost
and a large bucket is not paired with itself. Candidates are verified by the exact Jaccard similarity of
their shingle sets. Verified pairs are joined into components, and one line of each
stays: the first by doc_id and line number.

At similarity s the bands find a pair with probability 1 - (1 - s**3)**7: 0.993 at 0.8, 0.9996 at 0.87.
Defined results: null texts have no lines, empty texts one blank line; rows of one id and text are copies, of which
one keeps its lines; ties are broken by doc_id and line number; further columns may have any name.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleguard.llm.bloom import likely
from tripleguard.llm.components import connected_components
from tripleguard.llm.shared import partitions, remove, written

SHINGLE = 10
BANDS, ROWS = 7, 3
SIMILARITY = 0.8
_CONSTANTS = [random.Random(i).getrandbits(31) for i in range(BANDS * ROWS)]
#: 64-bit words of the two bitmaps of shingles.
SMALL, LARGE = 16, 64


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, place (doc_id, line_no from 0, row_key), line, node of each line that isn't blank."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return (
        rows.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")
        .select("row_key", F.struct("doc_id", "line_no", "row_key").alias("place"), "line", F.xxhash64("line").alias("node"))
    )


def shingles(nodes: DataFrame, *keys: str) -> DataFrame:
    """keys and the hashes h0 and h1 of two neighbouring windows of SHINGLE characters, for every other one of each line.

    Two windows a row halve the work of what aggregates them; a last window without neighbour comes twice.
    """
    # four bytes for each character, so that any window is cut out at once
    points = nodes.select(*keys, F.encode("line", "UTF-32").alias("p")).select(*keys, "p", F.greatest(F.lit(1), F.octet_length("p") - 4 * SHINGLE + 1).alias("last"))
    at = points.select(*keys, "p", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(8))).alias("i"))
    window = lambda i: F.xxhash64(F.substring("p", i, F.lit(4 * SHINGLE)))
    return at.select(*keys, window(F.col("i")).alias("h0"), window(F.least(F.col("i") + 4, F.col("last"))).alias("h1"))


def windows(line: Column) -> Column:
    """The distinct windows of SHINGLE characters; the whole of a shorter line."""
    every = F.regexp_extract_all(line, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))."), F.lit(1))
    return F.array_distinct(F.when(F.char_length(line) < SHINGLE, F.array(line)).otherwise(every))


def signatures(nodes: DataFrame) -> DataFrame:
    """node, weight, m0..: the least values of each node. nodes: node, line, weight."""
    low = lambda h: F.col(h).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    rows = shingles(nodes, "node", "weight").select("node", "weight", low("h0").alias("h0"), low("h1").alias("h1"))
    least = lambda c: F.min(F.least(F.col("h0").bitwiseXOR(F.lit(c)), F.col("h1").bitwiseXOR(F.lit(c))))
    return rows.groupBy("node").agg(F.max("weight").alias("weight"), *(least(c).alias(f"m{i}") for i, c in enumerate(_CONSTANTS)))


def bitmaps(texts: DataFrame, words: int) -> DataFrame:
    """node, a bitmap of its windows in so many words w0... (a power of two), n_bits (set in it) and hidden (windows that set no bit of their own). texts: node, line."""
    sized = texts.withColumn("size", F.greatest(F.lit(1), F.char_length("line") - SHINGLE + 1))
    word = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(h).bitwiseAND(F.lit(63)).cast("int"))
    rows = shingles(sized, "node", "size").select("node", "size", *(c for h in ("h0", "h1") for c in (word(h).alias(f"word_{h}"), bit(h).alias(f"bit_{h}"))))
    own = lambda k, h: F.when(F.col(f"word_{h}") == k, F.col(f"bit_{h}")).otherwise(F.lit(0).cast("bigint"))
    maps = rows.groupBy("node").agg(F.max("size").alias("size"), *(F.bit_or(own(k, "h0").bitwiseOR(own(k, "h1"))).alias(f"w{k}") for k in range(words)))
    each = [F.col(f"w{k}") for k in range(words)]
    return maps.withColumn("n_bits", sum(map(F.bit_count, each), F.lit(0))).select("node", "n_bits", (F.col("size") - F.col("n_bits")).alias("hidden"), *each)


def possible(pairs: DataFrame, maps: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the similarity; none that reaches it is lost.

    A bit that only one side has stands for a shingle at least that only this side has, so with x bits in
    common at most x + hidden shingles are common, and at least n_bits_a + n_bits_b - 2 x are not.
    """
    side = lambda s: maps.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in maps.columns if c != "node"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    common = sum((F.bit_count(F.col(f"w{k}_a").bitwiseAND(F.col(f"w{k}_b"))) for k in range(words)), F.lit(0))
    least = similarity * (F.col("n_bits_a") + F.col("n_bits_b")) - (1 - similarity) * F.least("hidden_a", "hidden_b")
    return both.where(common * (1 + similarity) + 1e-9 >= least).select("a", "b")


def refined(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs that large bitmaps allow, which are made only of the nodes in pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    large, large_at = written(bitmaps(texts.join(ends, "node"), LARGE))
    found, _ = written(possible(pairs, large, LARGE, similarity))
    remove(pairs.sparkSession, large_at)
    return found


def similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets reach the similarity. texts: node, line."""
    side = lambda s: texts.select(F.col("node").alias(s), F.col("line").alias(f"line_{s}"))
    lines = pairs.join(side("a"), "a").join(side("b"), "b").repartition(partitions(pairs), "a", "b")
    sets = lines.select("a", "b", F.explode(F.array(F.struct(windows(F.col("line_a")).alias("x"), windows(F.col("line_b")).alias("y")))).alias("s"))
    common = F.size(F.array_intersect("s.x", "s.y"))
    return written(sets.where(common * (1 + similarity) >= similarity * (F.size("s.x") + F.size("s.y")) - 1e-9).select("a", "b"))[0]


def shared_levels(hashes: DataFrame) -> tuple[DataFrame, str]:
    """h, level (from 4, grows with how often h occurs) of the shingles that two nodes hold at least. hashes: node, h."""
    counted = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    return written(counted.select("h", F.least(F.lit(126), F.floor(4 * F.log2("n"))).cast("bigint").alias("level")))


def prefix_pairs(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a shingle of their prefixes. placed: node, component.

    Shingles come by how many times they occur, counted exactly, so that at any size a prefix holds the rarest ones; a node's
    prefix is what a partner must share one of. Shingles of one node alone come first and need not be met. The shingles before
    the first common one belong to one node each, which bounds the similarity; so most nodes that merely hold the same passage never meet.
    """
    lines = texts.join(placed, "node").select("node", "component", "line").repartition(partitions(placed), "node")
    hashes = lambda *keys: shingles(lines, *keys).select(*keys, F.explode(F.array("h0", "h1")).alias("h"))
    levels, levels_at = shared_levels(hashes("node"))
    level = F.coalesce("level", F.lit(0).cast("bigint"))
    key = F.call_function("shiftleft", level, F.lit(56)).bitwiseOR(F.shiftrightunsigned("h", 8))
    ranked = hashes("node", "component").join(levels, "h", "left").select("node", "component", key.alias("key"))
    sets = ranked.groupBy("node", "component").agg(F.sort_array(F.collect_set("key")).alias("x")).select("node", "component", F.size("x").alias("n"), "x")
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    tokens, tokens_at = written(sets.select("node", "component", "n", F.posexplode(F.slice("x", F.lit(1), first)).alias("before", "h")).where(F.shiftright("h", 56) > 0))
    x, y = (tokens.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "n", "before"))) for s in "xy")
    rest_x, rest_y = F.col("n_x") - F.col("before_x"), F.col("n_y") - F.col("before_y")
    allowed = F.least(rest_x, rest_y) + 1e-9 >= similarity * (F.col("before_x") + F.col("before_y") + F.greatest(rest_x, rest_y))
    met, _ = written(x.join(y, "h").where("node_x < node_y and component_x != component_y").where(allowed).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct())
    remove(placed.sparkSession, levels_at, tokens_at)
    return met


def _buckets(nodes: DataFrame) -> tuple[DataFrame, str]:
    """node, bucket, centre (a node of most occurrences) for each bucket of two nodes or more. nodes: node, line, weight."""
    bands = F.array(*(F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)))
    signed, signed_at = written(signatures(nodes).select("node", "weight", bands.alias("bands")))
    members = signed.select("node", "weight", F.explode("bands").alias("bucket"))
    # occurrences first, then the node; one number, so that no rows are sorted for it
    order = F.call_function("shiftleft", F.least("weight", F.lit(32767)), F.lit(48)).bitwiseOR(F.shiftrightunsigned("node", 16))
    # aggregated and joined back rather than windowed, so that a crowded bucket is spread
    crowded, crowded_at = written(members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", order).alias("centre")).where("low != high").select("bucket", "centre"))
    found = written(likely(members.select("node", "bucket"), "bucket", crowded, crowded.count()).join(crowded, "bucket").select("node", "bucket", "centre"))
    remove(nodes.sparkSession, signed_at, crowded_at)
    return found


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """component (node, component) after further links (a, b): only the components that they touch are joined up."""
    of = lambda s: component.select(F.col("node").alias(s), F.col("component").alias(f"component_{s}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b"))
    renamed = connected_components(between, "a", "b").withColumnRenamed("component", "joined")
    old = component.join(renamed.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    # a node without links so far is its own component, and no row of component
    new = renamed.join(component.select("component").distinct().withColumnRenamed("component", "node"), "node", "left_anti").select("node", F.col("joined").alias("component"))
    return written(old.unionByName(new))[0]


def node_components(nodes: DataFrame, nodes_at: str, similarity: float = SIMILARITY) -> DataFrame:
    """node, component for each node that is linked with another. nodes: node, line, weight, written at nodes_at, which goes."""
    spark = nodes.sparkSession
    mates, mates_at = _buckets(nodes)
    wanted, wanted_at = written(mates.select("node").distinct())
    texts, texts_at = written(likely(nodes.select("node", "line"), "node", wanted, wanted.count()).join(wanted, "node"))
    remove(spark, nodes_at)
    maps, maps_at = written(bitmaps(texts, SMALL))
    stars, stars_at = written(mates.where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    near, near_at = written(possible(stars, maps, SMALL, similarity))
    component = connected_components(similar(near, texts, similarity), "a", "b")
    # the centre has met all of its bucket; what is open are pairs of the others
    others = mates.where("node != centre").join(component, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component"))
    divided = others.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    placed, placed_at = written(others.join(divided, "bucket", "left_semi").select("node", "component").distinct())
    rest, rest_at = written(possible(prefix_pairs(placed, texts, similarity).join(stars, ["a", "b"], "left_anti"), maps, SMALL, similarity))
    more = similar(refined(rest, texts, similarity), texts, similarity)
    if not more.isEmpty():
        component = merged(component, more)
    remove(spark, mates_at, wanted_at, texts_at, maps_at, stars_at, near_at, placed_at, rest_at)
    return component


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key (hash of id and text), removed: numbers of the lines that are not the first of their component."""
    spark = docs.sparkSession
    lines = lines_of(docs, doc_id, text)
    # all distinct text at once, beside the shuffle that made it: the most disk of all steps
    nodes, nodes_at = written(lines.groupBy("node", "line").agg(F.count(F.lit(1)).alias("weight")), "zstd")
    repeated, repeated_at = written(nodes.where("weight > 1").select("node", F.col("node").alias("component")))
    linked = node_components(nodes, nodes_at, similarity)
    # a node that occurs once and is like no other loses nothing
    shared, shared_at = written(linked.unionByName(repeated.join(linked, "node", "left_anti")))
    placed, placed_at = written(likely(lines.select("row_key", "place", "node"), "node", shared, shared.count()).join(shared, "node").select("row_key", "place", "component"))
    # written, so that a line of very many places is spread in the join
    first, first_at = written(placed.groupBy("component").agg(F.min("place").alias("first")))
    gone, _ = written(placed.join(first, "component").where("place != first").groupBy("row_key").agg(F.array_sort(F.collect_set("place.line_no")).alias("removed")))
    remove(spark, repeated_at, shared_at, placed_at, first_at)
    return gone


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text column reduced to the lines that stay, and the columns n_lines and removed behind its own.

    Of rows of one id and text one stays, since the others would keep no line.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "removed")]
    gone = removed_lines(docs, similarity, doc_id, text).withColumnRenamed("row_key", "_row_key")
    keyed = docs.select(*own, F.xxhash64(doc_id, text).alias("_row_key"))
    repeated, _ = written(keyed.groupBy("_row_key").count().where("count > 1").select("_row_key"))
    copies = keyed.join(repeated, "_row_key", "left_semi").groupBy("_row_key").agg(F.first(F.struct(*own)).alias("_row")).select(*(F.col(f"_row.`{c}`").alias(c) for c in own), "_row_key")
    joined = keyed.join(repeated, "_row_key", "left_anti").unionByName(copies).join(gone, "_row_key", "left")
    lines = F.split(F.col(text), "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed"), lambda i: F.get(lines, i))
    return joined.select(
        *(F.when(F.col("removed").isNull(), F.col(c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(c) for c in own),
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def line_report(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined) for each row of docs."""
    gone = removed_lines(docs, similarity, doc_id, text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    full = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(line) != "", i)), lambda i: i.isNotNull())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col(text).isNotNull(), full).alias("full"))
    copies = rows.groupBy("doc_id", "row_key", "n_lines", "full").count()
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    # of equal rows the first keeps its lines and the others keep none
    each = copies.join(gone, "row_key", "left").select("doc_id", "n_lines", "full", removed.alias("removed"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    said = F.when(F.col("copy") == 1, F.col("removed")).otherwise(F.coalesce("full", F.array().cast("array<int>")))
    return each.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), said.alias("r")).select("doc_id", "n_lines", F.size("r").cast("long").alias("n_removed"), F.array_join(F.col("r").cast("array<string>"), ",").alias("removed"))

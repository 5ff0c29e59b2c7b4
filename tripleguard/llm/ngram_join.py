"""Jaccard join of documents on word n-grams, filtered by several global token orders.

A document is the set of its distinct shingles, kept as 64-bit hashes. Documents of one set form a
class. A global order puts shingles of frequent hash buckets last, by levels that are fine in the first order and
coarse in the others; within a level each order sorts by another hash. Two classes can reach the threshold only if their prefixes, the first
n - ceil(t n) + 1 shingles, share one under every order. The first order finds candidates
by shuffling prefix shingles; candidates must then also meet under the other orders, and their whole sets
are compared. Lengths out of proportion are never compared.

Instead of all pairs that share a shingle, the smallest class of each shingle meets the
others; classes that such links join need no further comparison, and only pairs of shingle mates
from different components follow. So components are exact, without all pairs of a
group of copies.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; fewer words than n
make one shingle of the whole sequence; rows of one id are documents of their own and share a class if
their sets are equal; null ids are linked like others, and a component that has only such has a null component_id; further columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.bloom import likely
from tripleguard.llm.components import connected_components
from tripleguard.llm.shared import partitions, remove, slices, written

WORDS = 4
#: Per cent of the union that two sets must share.
PERCENT = 85
#: Counters of the frequency sketch that the token orders use, and those of one row of it; fixed, whatever the input.
BUCKETS, ROW = 1 << 22, 1 << 12
#: Levels of frequency in one doubling, and how many of them make one level of the coarse orders.
FINE = 8
ORDERS = 3
#: Classes of one block when pairs are compared.
UNIT = 256

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]
_random = np.random.Generator(np.random.PCG64(2024))
_STEP = 0x9E3779B97F4A7C15
_PLACE = _random.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (the finaliser of SplitMix64)."""
    x = x + np.uint64((seed * _STEP) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words text[start:end] (bytes, lower-cased, at least 8 more behind the last).

    Eight bytes at a time go through the mixing, all words of that length together, so each byte's effect depends on all before it;
    long words take a keyed digest instead.
    """
    eight = np.ndarray(len(text) - 7, "<u8", text.data, strides=(1,))
    size = end - start
    h = mixed(size.astype(np.uint64), 3)
    at, rest = np.flatnonzero(size <= LONG_WORD), None
    for first in range(0, LONG_WORD, 8):
        rest = size[at] - first
        at, rest = at[rest > 0], rest[rest > 0]
        if not len(at):
            break
        unused = np.uint64(8) * np.maximum(8 - rest, 0).astype(np.uint64)
        h[at] = mixed(h[at] ^ mixed(eight[start[at] + first] << unused, 4), 2)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(text[start[i] : end[i]].data, digest_size=8, key=b"word").digest(), "little")
    return h


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    raw = [t.encode() if t else b"" for t in texts]
    b = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" " * 9, np.uint8)]
    first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    sep = _SEPARATOR[b]
    start, end = np.flatnonzero(sep[:-1] & ~sep[1:]) + 1, np.flatnonzero(~sep[:-1] & sep[1:]) + 1
    word = word_hashes(b, start, end)
    bounds = np.searchsorted(start, first)
    out = []
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for i in range(words):
        whole += word[i : len(word) - words + 1 + i] * _PLACE[i]
    whole = mixed(whole)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(whole[lo : hi - words + 1]))
        elif hi > lo:
            few = np.uint64(hi - lo)
            for i in range(hi - lo):
                few = few + word[lo + i : lo + i + 1] * _PLACE[i]
            out.append(mixed(few, 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of the set."""
    if not len(shingles):
        return 0
    h = np.add.reduce(mixed(shingles, 5), keepdims=True) + np.bitwise_xor.reduce(mixed(shingles, 6), keepdims=True) * np.uint64(_STEP)
    return int(mixed(h, 7).view(np.int64)[0])


def needed(n: int, percent: int) -> int:
    """Shingles that any partner of a set of n must share with it."""
    return -(-percent * n // 100)


def prefix(shingles: np.ndarray, levels: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The shingles of which a partner must have one, in the given order."""
    k = len(shingles) - needed(len(shingles), percent) + 1
    level = levels[shingles % np.uint64(BUCKETS)] // (FINE if order else 1)
    key = mixed(shingles, 11 + order) >> np.uint64(8) | level.astype(np.uint64) << np.uint64(56)
    first = np.argpartition(key, k - 1)[:k] if k < len(shingles) else np.arange(len(shingles))
    return shingles[first[np.argsort(key[first])]]


def _passes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, str]:
    """(doc_id, key, n, class) of each row, and (row, counts) of the sketch of each task: counts is compressed. Both are written at the place given."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("row", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                sets = shingle_sets(part.column(1).to_pylist(), words)
                np.add.at(counts, (np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), 1)
                none = pa.nulls(len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets]), pa.array([class_of(s) for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        rows = counts.reshape(-1, ROW)
        full = np.flatnonzero(rows.any(axis=1))
        none = pa.nulls(len(full), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(full.astype(np.int32)), pa.array([zlib.compress(rows[i], 1) for i in full], pa.binary())], schema=schema)

    both, both_at = written(docs.mapInArrow(run, "doc_id long, key long, n long, class long, row int, counts binary"))
    return both.where("row is null").select("doc_id", "key", "n", "class"), both.where("row is not null").select("row", "counts"), both_at


def _levels(counts: DataFrame) -> np.ndarray:
    """Level of frequency of each bucket, FINE levels to a doubling."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sketch come together, so that one sum is held at a time."""
        at, total = None, np.zeros(ROW, np.int64)

        def done() -> pa.RecordBatch:
            level = np.minimum(np.floor(np.log2(np.maximum(total, 1)) * FINE), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["row", "levels"])

        for batch in batches:
            for row, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != at:
                    if at is not None:
                        yield done()
                    at, total = row, np.zeros(ROW, np.int64)
                total += np.frombuffer(zlib.decompress(packed), np.uint32)
        if at is not None:
            yield done()

    levels = np.zeros((BUCKETS // ROW, ROW), np.uint8)
    for r in counts.repartition(partitions(counts), "row").sortWithinPartitions("row").mapInArrow(add, "row int, levels binary").collect():  # BUCKETS bytes
        levels[r["row"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.ravel()


def _possible(n: str, before: str, m: str, ahead: str, percent: int) -> Column:
    """Whether sets of n and m, whose first common shingle follows so many others in each, can be similar enough.

    The shingles before it belong to one set only; those from it on are all that can be common. At a common shingle that is not the
    first, the test may fail, but then it has held at the first.
    """
    rest_n, rest_m = F.col(n) - F.col(before), F.col(m) - F.col(ahead)
    return F.least(rest_n, rest_m).cast("long") * 100 >= (F.col(before) + F.col(ahead) + F.greatest(rest_n, rest_m)).cast("long") * percent


def _enough(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs that share enough prefix shingles for the threshold. prefixes: class, n, t (tokens).

    Of two prefixes one ends first in the order; what is common up to there is common to both prefixes, and behind it at
    most the rest of that set can be.
    """
    side = lambda s: prefixes.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("t").alias(f"t_{s}"))
    rest = F.ceil(F.greatest("n_a", "n_b") * percent / 100) - 1
    most = F.least(F.size(F.array_intersect("t_a", "t_b")) + rest, F.col("n_a"), F.col("n_b"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "mate", "n_a", "n_b", most.alias("most"))
    return met.where(F.col("most") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b", "mate")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, levels, words: int, percent: int) -> tuple[DataFrame, str]:
    """The pairs (a, b) of classes whose sets reach the threshold, and their place. pairs: a, b, mate (a class that both are near).

    Classes with the same mate are compared in one place, so a set moves once for each such place and not
    for each pair; a mate of many classes is cut into blocks, and each pair of blocks is a place.
    """
    pairs, pairs_at = written(pairs)
    ends = pairs.select("mate", F.explode(F.array("a", "b")).alias("class")).distinct()
    blocks = ends.groupBy("mate").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("long").alias("blocks"))
    block = lambda end: F.pmod(F.xxhash64(end), F.col("blocks"))
    placed, placed_at = written(pairs.join(blocks, "mate").select("a", "b", F.xxhash64("mate", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("unit")))
    members = placed.select("unit", F.explode(F.array("a", "b")).alias("class")).distinct()
    wanted = members.groupBy("class").agg(F.collect_list("unit").alias("units"))
    reps, reps_at = written(wanted.join(classes, "class").groupBy("class").agg(F.min("key").alias("key"), F.first("units").alias("units")))
    sent = pa.schema([("unit", pa.int64()), ("class", pa.int64()), ("set", pa.binary()), ("b", pa.int64())])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows of one key are sent once by a task
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                new = [c not in seen and not seen.add(c) for c in part.column(0).to_pylist()]
                part = part.filter(pa.array(new, pa.bool_()))
                sets = [s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), words)]
                rows = [(u, c, s) for c, units, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets, strict=True) for u in units]
                for at in range(0, len(rows), 500):
                    some = rows[at : at + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[2] for r in some], pa.binary()), pa.nulls(len(some), pa.int64())], schema=sent)

    texts = likely(docs, "key", reps, reps.count()).join(reps, "key").select("class", "text", "units")
    sets = texts.mapInArrow(sets_of, "unit long, class long, set binary, b long")
    asked = placed.select("unit", F.col("a").alias("class"), F.lit(None).cast("binary").alias("set"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a unit come together, its sets before its pairs."""
        unit, held, prefixes, seen = None, {}, {}, levels.value

        def meet(x: int, y: int) -> bool:
            """Common prefix shingles under every further order, then the whole sets."""
            for k in range(1, ORDERS):
                for c in (x, y):
                    if (k, c) not in prefixes:
                        prefixes[k, c] = frozenset(prefix(held[c], seen, k, percent).tolist())
                if prefixes[k, x].isdisjoint(prefixes[k, y]):
                    return False
            s, t = held[x], held[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            return 100 * both >= percent * (len(s) + len(t) - both)

        for batch in batches:
            good: list[tuple[int, int]] = []
            for u, c, s, other in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if u != unit:
                    unit, held, prefixes = u, {}, {}
                if other is None:
                    held[c] = np.frombuffer(s, np.uint64)
                elif meet(c, other):
                    good.append((c, other))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in good], pa.int64()) for i in range(2)], names=["a", "b"])

    together = sets.unionByName(asked).repartition(partitions(docs), "unit").sortWithinPartitions("unit", F.col("b").asc_nulls_first())
    links = written(together.mapInArrow(compare, "a long, b long").distinct())
    remove(docs.sparkSession, pairs_at, placed_at, reps_at)
    return links


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    classes, counts, classes_at = _passes(docs, words)
    levels = docs.sparkSession.sparkContext.broadcast(_levels(counts))
    schema = pa.schema([("token", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("before", pa.int32())])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the classes that this task has met: copies are sent once
        for batch in batches:
            for part in slices(batch, 1, 1_000_000):
                tokens, names, sizes = [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), words):
                    name = class_of(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        tokens.append(prefix(s, levels.value, 0, percent))
                        names.append(name)
                        sizes.append(len(s))
                if tokens:
                    n = [len(t) for t in tokens]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), n)), pa.array(np.repeat(np.array(sizes, np.int32), n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))],
                        schema=schema,
                    )

    posted, posted_at = written(docs.mapInArrow(postings, "token long, class long, n int, before int"))
    # aggregated and joined back rather than windowed, so that a token of very many classes is spread
    shared, shared_at = written(posted.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low != high").select("token"))
    mates, mates_at = written(likely(posted, "token", shared, shared.count()).join(shared, "token").distinct())
    # the class with the fewest rare shingles before this one is the likeliest to be like the others
    centre = F.min_by(F.struct("class", "n", "before"), F.struct(F.col("before") / F.col("n"), F.col("class")))
    centres, centres_at = written(mates.groupBy("token").agg(centre.alias("c")))
    open_tokens, open_at = written(mates.join(centres, "token"))
    # written, so that a class that meets very many others is spread in the joins
    prefixes, prefixes_at = written(mates.groupBy("class").agg(F.first("n").cast("long").alias("n"), F.collect_list("token").alias("t")))
    remove(docs.sparkSession, posted_at, shared_at, mates_at, centres_at)
    stars = open_tokens.where("class != c.class").where(_possible("n", "before", "c.n", "c.before", percent)).select(F.least("c.class", "class").alias("a"), F.greatest("c.class", "class").alias("b"), F.col("c.class").alias("mate"))
    stars, stars_at = written(stars.groupBy("a", "b").agg(F.min("mate").alias("mate")))
    links, links_at = _verified(_enough(stars, prefixes, percent), docs, classes, levels, words, percent)
    first = connected_components(links, "a", "b")
    tagged, tagged_at = written(
        open_tokens.join(first.select(F.col("node").alias("class"), "component"), "class", "left")
        .select("token", "class", "n", "before", F.col("c.class").alias("centre"), F.coalesce("component", "class").alias("component"))
    )
    divided, divided_at = written(tagged.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token"))
    placed, placed_at = written(tagged.join(divided, "token"))
    x, y = (placed.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "before", "centre", "component"))) for s in "xy")
    rest = (
        x.join(y, "token")
        .where("class_x < class_y and class_x != centre_x and class_y != centre_x and component_x != component_y")
        .where(_possible("n_x", "before_x", "n_y", "before_y", percent))
        .select(F.col("class_x").alias("a"), F.col("class_y").alias("b"), F.col("centre_x").alias("mate"))
        .groupBy("a", "b")
        .agg(F.min("mate").alias("mate"))
    )
    met, met_at = written(rest)
    rest, rest_at = written(_enough(met, prefixes, percent))
    remove(docs.sparkSession, open_at, prefixes_at, stars_at, tagged_at, divided_at, placed_at, met_at)
    done = [classes_at, links_at, rest_at]
    if not rest.isEmpty():
        more, more_at = _verified(rest, docs, classes, levels, words, percent)
        links = links.unionByName(more)
        done.append(more_at)
    linked = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    named, _ = written(classes.join(linked, "class", "left").select("doc_id", "n", F.coalesce("component", "class").alias("group")))
    # written, so that a group of very many rows is spread in the join
    smallest, _ = written(named.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("component_id")))
    remove(docs.sparkSession, *done)
    return named.join(smallest, "group", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )

"""Spelling variants: words one edit apart, found by a trie joined with itself, and the commoner form that each word leads to.

Words and their counts come from one aggregation over all texts. The vocabulary is then cut into tries by what a pair
of near words shares. Let m be the length of the shorter word of a pair: all that stands before the edit is equal in both, and
so is all that stands behind it. A trie therefore holds the words of m and m + 1 letters that share a prefix and a suffix,
with a window between them in which the edit lies. The first cut halves the word: one trie for each shared first half (the edit lies
behind it) and one for each shared second half. A trie of more than `limit` words is cut again by halves of its own window, as often as
it takes; a window of one letter holds no more words than there are letters and pairs of letters. A pair
counts in the window that holds its first difference alone, so no pair is lost or given twice.

Within a trie each node carries the set of its active nodes, the nodes whose path is one edit from its own. A child's set comes from
its parent's: the parent (a deletion), the siblings (a replacement), its own children (an insertion), and the active nodes of
the parent taken one letter on. Where two words end at active nodes of each other, they are a pair.

Defined results: a null text has no words; repeated rows count again; a null id draws as the empty string; of equally common near words the
smallest in code-point order wins; words without a near one are kept; an empty table gives an empty one. Only the two named columns
are read, so further columns may have any name. Long words cost time in proportion to their length: only the window goes into a trie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import partitions, remove, written

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "word string, n bigint, near string, near_n bigint"


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """The run without one letter where every divides the check sum of id and run, else as it is."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    short = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % every == 0, short).otherwise(run)


def vocabulary(docs: DataFrame, letters: str = LETTERS, shortest: int = 5, fewest: int = 3, every: int = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the runs of letters, lower-cased (A-Z only) and slipped, of so many letters that occur so often at least."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[{letters}]{{{shortest},}}"), F.lit(0))
    words = docs.select(F.col(doc_id).alias("id"), F.explode(runs).alias("run")).select(slipped(F.col("id"), F.col("run"), every).alias("word"))
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)


class _Node:
    __slots__ = ("children", "word", "n")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.word: str | None = None
        self.n = 0


def _trie(words: list[tuple[str, str, int]]) -> _Node:
    root = _Node()
    for window, word, n in words:
        node = root
        for letter in window:
            node = node.children.setdefault(letter, _Node())
        node.word, node.n = word, n
    return root


def near_pairs(words: list[tuple[str, str, int]]) -> Iterator[tuple[_Node, _Node]]:
    """Ends of words whose windows are one edit apart, each pair in both directions. words: window, word, n.

    Depth first, with a stack of iterators: a node's active set is dropped when the node is left.
    """
    root = _trie(words)
    stack = [(root, list(root.children.values()), iter(root.children.items()))]
    if root.word is not None:
        yield from ((root, v) for v in root.children.values() if v.word is not None)
    while stack:
        parent, active, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            continue
        letter, node = step
        found = {id(parent): parent}
        found |= {id(v): v for v in parent.children.values() if v is not node}
        found |= {id(v): v for v in node.children.values()}
        found |= {id(v): v for v in (a.children.get(letter) for a in active) if v is not None and v is not node}
        if node.word is not None:
            yield from ((node, v) for v in found.values() if v.word is not None)
        if node.children:
            stack.append((node, list(found.values()), iter(node.children.items())))


def first_difference(a: str, b: str) -> int:
    """How many letters the words share at their start."""
    at = 0
    for x, y in zip(a, b):
        if x != y:
            break
        at += 1
    return at


def group_pairs(words: list[tuple[str, str, int]], m: int, low: int, high: int) -> list[tuple[str, int, str, int]]:
    """The pairs (both directions) of one trie whose shorter word has m letters and whose first difference lies in its window."""
    found = []
    for a, b in near_pairs(words):
        if min(len(a.word), len(b.word)) == m:
            at = first_difference(a.word, b.word)
            if low <= at < high or at == high == m:
                found.append((a.word, a.n, b.word, b.n))
    return found


def _keyed(rows: DataFrame, windows: Column) -> DataFrame:
    """A row for each of the windows (m, low, high): the key of its trie, and what of the word lies between prefix and suffix."""
    length, behind = F.char_length("word"), F.col("m") - F.col("high")
    prefix, suffix = F.substr("word", F.lit(1), "low"), F.substr("word", length - behind + 1)
    window = F.substr("word", F.col("low") + 1, length - behind - F.col("low"))
    w = rows.select("word", "n", F.explode(windows).alias("w")).select("word", "n", "w.m", "w.low", "w.high")
    return w.select("word", "n", "m", "low", "high", F.concat(prefix, F.lit("\n"), suffix).alias("key"), window.alias("window"))


def _halves(m: Column, low: Column, high: Column) -> Column:
    middle = ((low + high) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), low.alias("low"), middle.alias("high")), F.struct(m.alias("m"), middle.alias("low"), high.alias("high")))


TRIE = ["m", "low", "high", "key"]


def tries(words: DataFrame, limit: int, shortest: int) -> tuple[list[DataFrame], list[str]]:
    """Rows of word, n, m, low, high, key and window in tries of at most limit words (or of windows of one letter), and the folders they lie in.

    A trie of a single word is left out. Only the keys of tries that are too large are joined back.
    """
    length = F.char_length("word")
    shorter = F.filter(F.array(length, length - 1), lambda m: m >= shortest)
    first = F.flatten(F.transform(shorter, lambda m: _halves(m, F.lit(0), m)))
    kept, folders, rows = [], [], _keyed(words, first)
    while True:
        rows, at = written(rows)
        folders.append(at)
        sizes = rows.groupBy(*TRIE).agg(F.count(F.lit(1)).alias("size"))
        large, large_at = written(sizes.where((F.col("size") > limit) & (F.col("high") - F.col("low") > 1)).select(*TRIE))
        folders.append(large_at)
        if large.isEmpty():
            kept.append(rows)
            return kept, folders
        kept.append(rows.join(large, TRIE, "left_anti"))
        rows = _keyed(rows.join(large, TRIE, "left_semi"), _halves(F.col("m"), F.col("low"), F.col("high")))


def near_words(words: DataFrame, limit: int = 20_000, shortest: int = 1) -> tuple[DataFrame, list[str]]:
    """word, n, near, near_n for each near word of each word, and the folders that they are read from."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
        last, held, out = None, [], []

        def closed() -> None:
            if len(held) > 1:
                out.extend(group_pairs(held, *last[:3]))

        for batch in batches:
            for m, low, high, key, window, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (m, low, high, key) != last:
                    closed()
                    last, held = (m, low, high, key), []
                held.append((window, word, n))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        closed()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    kept, folders = tries(words, limit, shortest)
    rows = reduce(DataFrame.unionByName, kept).select(*TRIE, "window", "word", "n")
    return rows.repartition(partitions(words), *TRIE).sortWithinPartitions(*TRIE).mapInArrow(work, PAIRS), folders


def follow(forms: DataFrame) -> tuple[DataFrame, list[str]]:
    """word, root: where the forms (word, form) lead, and the folders that hold it.

    Each round doubles the steps taken. A form is more common than its word, so there are no circles. A word whose target leads
    nowhere is done: it is joined no more, but stays in the table that others are looked up in.
    """
    going = forms.select("word", F.col("form").alias("root"))
    done, folders = [], []
    while True:
        table = reduce(DataFrame.unionByName, done, going).select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved, at = written(going.join(table, "root", "left").select("word", "root", "next"))
        folders.append(at)
        done.append(moved.where("next is null").select("word", "root"))
        going = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done), folders


def spelling_variants(
    docs: DataFrame, letters: str = LETTERS, shortest: int = 5, fewest: int = 3, every: int = 97, times: int = 2, limit: int = 20_000, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the vocabulary.

    form: the most common near word, if it is at least times as common as the word. root: where forms lead in the end, from the word itself.
    limit: words in a trie above which it is cut; results don't depend on it.
    """
    words, words_at = written(vocabulary(docs, letters, shortest, fewest, every, doc_id, text))
    pairs, folders = near_words(words, limit, shortest)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near, near_at = written(pairs.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best))
    form_n = -F.col("best.less")
    good = form_n >= times * F.col("n")
    formed = near.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, form_n).alias("form_n"))
    roots, steps = follow(formed.where("form is not null").select("word", "form"))
    found = words.join(formed, "word", "left").join(roots, "word", "left")
    result, _ = written(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))
    remove(docs.sparkSession, words_at, near_at, *folders, *steps)
    return result

"""Fill-in-the-middle documents, cut by a matcher that reads each text twice and stores no units.

A text's units are the matches of a pattern, left to right. The first pass only counts them; two drawn ranks then say
after how many units the prefix and the middle end, and the second pass advances a lazy iterator over the matches to
the smaller rank and on to the larger one. Beside the text itself a document needs a few integers, whatever its length.

Defined results: a null text counts as empty; an empty text, one that holds a mark, and one that the rate leaves out
stay plain (middle and prefix null); a null id draws as the empty string; repeated rows each get their row, and equal
ids with different texts their own cut; an empty table gives an empty one. Only the two named columns are read, so
further columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleguard.llm.shared import slices

#: Where the prefix, the suffix and the middle begin.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"
COLUMNS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def count_units(units: re.Pattern[str], text: str) -> int:
    """The first pass."""
    return sum(1 for _ in units.finditer(text))


def ends_after(units: re.Pattern[str], text: str, first: int, second: int) -> tuple[int, int]:
    """The second pass: where the unit numbers first <= second end (from 1; 0 is the start of the text)."""
    found, at, ends = units.finditer(text), 0, []
    passed = 0
    for rank in (first, second):
        while passed < rank:
            at, passed = next(found).end(), passed + 1
        ends.append(at)
    return ends[0], ends[1]


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four integers below 2**32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16), int(digest[16:24], 16), int(digest[24:32], 16)


def transform(units: re.Pattern[str], text: str, drawn: tuple[int, int, int, int], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    n = count_units(units, text)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or drawn[2] % 100 >= rate:
        return n, "plain", None, None, text
    ranks = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    a, b = ends_after(units, text, *ranks)
    if drawn[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(
    docs: DataFrame, pattern: str = LINES, seed: int = 0, rate: int = 100, spm_rate: int = 50, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars and output of each row.

    n counts the units. rate percent of the documents are cut, spm_rate percent of these have their suffix first.
    What the pattern leaves between two units belongs to the part that the later unit belongs to.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            for part in slices(batch, 1):
                rows = [transform(units, t or "", draws(seed, i), rate, spm_rate) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                columns = list(zip(*rows)) or [()] * 5
                made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, {COLUMNS}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Marks can't overlap and no part holds one, so the first of each is the one that was put."""

    def between(start: str, end: str | None) -> Column:
        begin = F.instr(output, start) + len(start)
        length = F.char_length(output) - begin + 1 if end is None else F.instr(output, end) - begin
        return output.substr(begin, length)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

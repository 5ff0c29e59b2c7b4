"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes of the lower-cased text, digits and
punctuation read as spaces), weighted by ln(1 + count) * inverse document frequency and
normalised. Each language has a few centroids, found by spherical k-means over a bounded sample of
labelled rows. A text gets the language of its nearest centroid by cosine and is
rejected where it is further from it than texts of its length may be: the limit of each length (by powers of
two of its n-grams) is learned from pieces of the sampled rows.

The fit uses per_lang rows of each language at most (those of the smallest hash of the id), a stated
bound; prediction covers every whole text. Defined results: null, empty and letterless texts get
`und`, score 0 and rejected; equal cosines go to the smaller language name; with no labelled row every
text is `und`; rows repeat as they come; further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIMENSIONS = 8192
#: Classes of length; a text is rejected below MARGIN times the cosine that all but QUANTILE of the pieces of its class reach.
CLASSES, MARGIN, QUANTILE = 24, 0.8, 0.005
#: Marks (vowel signs, accents) belong to the letters that they stand on.
NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of_lang: np.ndarray
    least_cosine: np.ndarray  # by size_class()


def counts_of(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams; None for a text without a letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return None
    b = np.frombuffer(f" {words} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] * 256 + b[1:]
    three = two[:-1] * 256 + b[2:]
    grams = np.concatenate([b * 2654435761 + 1, two * 2654435761 + 2, three * 2246822519 + 3])
    grams ^= grams >> 15
    grams *= np.uint32(2654435761)
    return np.bincount(grams >> np.uint32(19), minlength=DIMENSIONS)


def size_class(counts: np.ndarray) -> int:
    return min(CLASSES - 1, int(counts.sum()).bit_length())


def vectors_of(counts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    m = np.stack(counts).astype(np.float64)
    np.log1p(m, out=m)
    m *= idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from far points; deterministic."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        near = np.max(np.stack([x @ c for c in centres]), axis=0)
        centres.append(x[int(np.argmin(near))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_lang: int = 300, k: int = 4) -> Model:
    """Learns from per_lang rows of each language at most; rows without language or letters don't count."""
    rows = labelled.select(
        F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    ).where("lang is not null and text is not null and text rlike '\\\\p{L}'")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key")
    # a few times per_lang rows of each language reach the window, however many there are
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of_lang"))  # one row a language
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) * F.col("of_lang") < F.lit(4 * per_lang << 20)
    picked = rows.join(F.broadcast(sizes), "lang").where(share).select("key", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang).select("key", "lang")
    # bounded: per_lang rows of each language
    sample = rows.join(F.broadcast(picked), ["key", "lang"]).orderBy("lang", "key").collect()
    counts = [(r["lang"], c.astype(np.int32)) for r in sample if (c := counts_of(r["text"])) is not None]
    langs = sorted({x for x, _ in counts})
    if not langs:
        return Model([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)), np.zeros(0, int), np.zeros(CLASSES))
    seen = sum((c > 0).astype(np.int64) for _, c in counts)
    idf = np.log((1 + len(counts)) / (1 + seen)) + 1
    x, own = vectors_of([c for _, c in counts], idf), np.array([langs.index(a) for a, _ in counts])
    parts = [clusters(x[own == i], k) for i in range(len(langs))]
    centroids = np.concatenate(parts)
    return Model(langs, idf, centroids, np.repeat(np.arange(len(langs)), [len(p) for p in parts]), limits([r["text"] for r in sample], idf, centroids))


def limits(texts: list[str], idf: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The least cosine of each class of length, from one piece of each text for each class that it can fill."""
    least = np.zeros(CLASSES)
    for size in range(4, CLASSES):
        length = (1 << size) // 4  # three n-grams a byte
        pieces = [t[(first := zlib.crc32(t.encode()) % (len(t) - length + 1)) : first + length] for t in texts if len(t) >= length]
        cosines = []
        for at in range(0, len(pieces), 64):
            if counts := [c for p in pieces[at : at + 64] if (c := counts_of(p)) is not None]:
                cosines.append(np.max(vectors_of(counts, idf) @ centroids.T, axis=1))
        least[size] = MARGIN * float(np.quantile(np.concatenate(cosines), QUANTILE)) if cosines else 0.0
    # longer texts are nearer; a class that too few texts fill takes the limit of the one before
    return np.maximum.accumulate(least)


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float, bool]]:
    """(language, score, rejected) of each text."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
    if not model.langs:
        return out
    for at in range(0, len(texts), 128):
        counts = [(i, c) for i in range(at, min(at + 128, len(texts))) if texts[i] and (c := counts_of(texts[i])) is not None]
        if not counts:
            continue
        cosines = vectors_of([c for _, c in counts], model.idf) @ model.centroids.T
        for (i, c), row in zip(counts, cosines, strict=True):
            best = int(np.argmax(row))
            score = float(min(1.0, max(0.0, row[best])))
            out[i] = (model.langs[model.of_lang[best]], score, score < model.least_cosine[size_class(c)])
    return out


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the columns lang_pred, score and rejected put behind its own."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    place = own.index(text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                said = predict(part.column(place).to_pylist(), held.value)
                more = [pa.array([s[i] for s in said], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "lang_pred", "score", "rejected"])

    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*own).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4, is 2: such rows are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2

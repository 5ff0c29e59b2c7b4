"""Every stage of the pipeline against a plain version of it, each on what the stage before it has kept."""

import base64
import hashlib
import re

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from test_mended import plain_cosine

from tripleguard.llm import language_id, line_dedup
from tripleguard.llm.queries import RANKS

SF = "/root/testdata/sf0.001"


def groups(names, linked):
    """The smallest name of each name's group."""
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in names}


def similar(sets, hundredths):
    """Pairs of names whose sets are similar enough, smaller sets first; sizes alone rule most pairs out."""
    order = sorted((n for n in sets if sets[n]), key=lambda n: len(sets[n]))
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 100 * len(sets[a]) < hundredths * len(sets[b]):
                break
            if 100 * (both := len(sets[a] & sets[b])) >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                yield a, b


def plain_languages(spark, docs):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~language_id.held_out()))
    for d, t in docs.items():
        counts = language_id.counts_of(t) if t else None
        if counts is not None and plain_cosine(t, model)[1] >= model.least_cosine[language_id.size_class(counts)]:
            yield d, t


def plain_lines(docs):
    lines = {(d, n): x for d, t in docs.items() for n, x in enumerate(t.split("\n")) if x.strip()}
    first = {}
    for at in sorted(lines):
        first.setdefault(lines[at], at)
    size = line_dedup.SHINGLE
    sets = {at: frozenset(x[i : i + size] for i in range(max(1, len(x) - size + 1))) for x, at in first.items()}
    kept = groups(sets, similar(sets, 80))
    for d, t in docs.items():
        rest = [x for n, x in enumerate(t.split("\n")) if not x.strip() or kept[first[x]] == (d, n)]
        text = "\n".join(rest)
        if text == t or text.strip(" "):
            yield d, text


def plain_near(docs):
    sets = {}
    for d, t in docs.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    kept = groups(sets, similar(sets, 85))
    return ((d, t) for d, t in docs.items() if kept[d] == d)


def plain_clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    for d, t in docs.items():
        w = words(t)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            yield d, t


def test_stages_equal_plain_versions(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {
        "language_id": lambda docs: plain_languages(spark, docs), "line_dedup": plain_lines, "ngram_join": plain_near, "decontaminate": lambda docs: plain_clean(docs, items),
    }
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs, _ = corpus_pipeline.written(stage(spark, docs, SF))
        rows = docs.collect()
        assert docs.columns == list(corpus_pipeline.COLUMNS) and len({r["doc_id"] for r in rows}) == len(rows)
        assert {r["doc_id"]: r["text"] for r in rows} == dict(plain[name](before)), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
        sizes.append(len(rows))
    # decisions took effect, and most documents are clean
    assert 200 >= sizes[0] > sizes[1] > sizes[3] > 100
    out = {r["doc_id"]: r for r in corpus_pipeline.count_tokens(spark, docs, SF).collect()}
    assert set(out) == {r["doc_id"] for r in rows}
    for r in rows:
        ids = np.array(library.encode_ordinary(r["text"]), "<u4").tobytes()
        got = out[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())

"""The text operators against brute force, and their defined results on odd rows."""

import base64
import hashlib
import itertools
import json

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tripleguard.llm import bpe, components, decontaminate, html_extract, language_id, license_scan, line_dedup, multi_index, ngram_join, secrets, url_filter
from tripleguard.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, h int, node string"
ODD = [
    (1, None, "en", 0, "x"), (2, "", "en", 0, "x"), (3, "One line only here. " * 3, "en", 0, "x"), (3, "One line only here. " * 3, "en", 0, "x"),
    (4, " \n\t ", None, 0, "x"), (5, "word " * 30_000, "en", 0, None), (6, "12 34", "de", 0, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def tables(db):
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    want = tables(duckdb.connect()).execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(map(str, (tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()))) == sorted(map(str, rows))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (80, 90), (7, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 80: 80, 90: 80}


def test_html_keeps_the_article(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><header>site</header><article><header><h1>A &amp; B</h1></header><p>one <b>two</b>\n three<br>four<p>five<div class='comments'>no</div></article><aside>x</aside><footer>y</footer></body></html>"
    bare = lambda s: f"<div>Top bar</div><p>{s}</p><div>All pages end so</div>"
    rows = [(1, "http://a.b/1", page), (2, None, None), (3, "http://c.d/x/1", bare("first")), (4, "http://c.d/x/2", bare("second")), (5, "no url", ""), (1, "http://a.b/1", page)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()]
    text = "A & B\none two three four\nfive"
    assert sorted(got) == sorted([(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "first", 5), (4, "second", 6), (5, "", 0)])


def test_html_form_around_the_page():
    page = "<body><form><nav>Menu</nav><input><article><p>One.</p><form>Your name <input></form><p>Two.</p></article><p>Sign in</p></form></body>"
    assert html_extract.page_lines(page)[0] == ["One.", "Two."]
    assert html_extract.page_lines("<body><p>Text.</p><form>Sign in</form></body>")[0] == ["Text."]


def test_html_copies_of_a_plain_page_keep_their_text(spark):
    bare = lambda s: f"<div>Top bar</div><p>{s}</p><div>All pages end so</div>"
    rows = [(1, "http://c.d/x/1", bare("first")), (2, "http://c.d/x/1?a=2", bare("first")), (2, "http://c.d/x/1?a=2", bare("first")), (3, "http://c.d/x/2", bare("second"))]
    rows += [(4, None, bare("no url")), (5, None, bare("no url")), (6, "http://e.f/1", bare("alone")), (7, "http://e.f/1", bare("alone"))]
    rows += [(8, "http://c.d/x/1", f"<article>{bare('first')}</article>"), (9, "http://c.d/x/1", "")]
    whole = lambda s: f"Top bar\n{s}\nAll pages end so"
    want = [(1, "first"), (2, "first"), (2, "first"), (3, "second"), (4, whole("no url")), (5, whole("no url")), (6, whole("alone")), (7, whole("alone")), (8, whole("first")), (9, "")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == want


def test_html_pairs_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://c.d/{i // 2}/{i}", f"<div>Bar {i // 2}</div><p>text {i}</p>") for i in range(42)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"text {i}") for i in range(42)]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).tolist() for _ in "ab")
        best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(range(len(a)), n) if is_sub([a[i] for i in c], b)), default=0)
        got = sorted(html_extract.shared(a, b))
        assert len(got) == best and is_sub([a[i] for i in got], b)


def is_sub(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_multi_index_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(5000, None, 0), (5020, [0.0] * 16, 0), (5040, [float("nan")] * 16, 0)]
    got = multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 20 == 0, centroids=16, entries_per_block=700, queries_per_block=60).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert len(by) == 100
    hits = 0
    for q, found in by.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in found})
        assert [r["rank"] for r in sorted(found, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
        assert all(abs(s[r["vec_id"]] - r["score"]) < 1e-9 for r in found)
    assert hits / 2000 >= 0.9
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_bpe_of_long_words():
    """The heap that contracts long pieces agrees with the recursive query and with the tiktoken library, and is not quadratic."""
    ranks = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    codec = bpe.Codec(ranks, P.PATTERN)
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})
    rng = np.random.default_rng(9)
    for size in (1, 2, 30, 400):
        word = "".join(rng.choice(list("abcdeéthinr中文学"), size))
        (ids, back), = codec.encode([word])
        assert b"".join(codec.contract(p.encode()) for p in codec.find(word)) == ids and back == word.encode()
    long = "".join(rng.choice(list("abcdefthin"), bpe.LONG * 4))
    (ids, back), = codec.encode([long])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(long) and back == long.encode()
    (ids, back), = codec.encode(["a" * 1_000_000])
    assert back == b"a" * 1_000_000


def test_bpe_equals_tiktoken(spark, odd):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd.unionByName(spark.createDataFrame([(7, "Ünïcode 中文 😀 <|endoftext|>  don't\n\n x", "de", 0, "")], DOCS))
    encoded = bpe.encode(docs, path, P.PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(encoded, path, P.PATTERN).collect()}
    assert back == texts


def jaccard(a, b, n=line_dedup.SHINGLE):
    s, t = ({x[i : i + n] for i in range(max(1, len(x) - n + 1))} for x in (a, b))
    return len(s & t) / len(s | t)


def test_line_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(8)]
    rows = []
    for i in range(60):
        x = list(base[i % 8])
        for _ in range(int(rng.integers(0, 2))):
            x[int(rng.integers(0, 200))] = "Z"
        rows.append((i, f"{''.join(x)}\n\nown line {i} {''.join(rng.choice(list('xyzw'), 40))}", "en", 0, "x"))
    got = {r["doc_id"]: r["removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    lines = [(i, n, x) for i, t, *_ in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    parent = list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(lines)), 2):
        if jaccard(lines[i][2], lines[j][2]) >= 0.8 and find(i) != find(j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: [] for i, *_ in rows}
    for i, (d, n, _) in enumerate(lines):
        if find(i) != i:
            want[d].append(n)
    assert got == want


def test_line_dedup_on_odd_rows(spark, odd):
    got = sorted((r["doc_id"], r["n_lines"], r["removed"]) for r in line_dedup.line_report(odd).collect())
    # of the two equal rows one keeps its line
    assert got == [(1, 0, ""), (2, 1, ""), (3, 1, ""), (3, 1, "0"), (4, 2, ""), (5, 1, ""), (6, 1, "")]
    assert line_dedup.line_report(odd.limit(0)).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(odd).collect()), key=str)
    assert kept == sorted(((d, t) for d, t in {(r[0], r[1]) for r in ODD}), key=str)


def test_line_dedup_of_a_passage_in_many_lines(spark):
    """Lines that share half of their text crowd the buckets; the bitmaps and the prefix filter lose none that is similar."""
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é中😀"), 120))
    lines = []
    for i in range(150):
        own = "".join(rng.choice(list("stuvwxyz "), 60))
        lines += [passage + own] if i % 3 else [passage + own, passage + own[:-4] + "QQQQ", own]
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if r["removed"]}
    near, parent = [], list(range(len(lines)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [frozenset(x[i : i + line_dedup.SHINGLE] for i in range(max(1, len(x) - line_dedup.SHINGLE + 1))) for x in lines]
    for i, j in itertools.combinations(range(len(lines)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            near.append((i, j))
            parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {i for i in range(len(lines)) if find(i) != i}
    assert len(near) >= 50 and got <= want and len(got) >= 0.9 * len(want)


def test_secrets(spark):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    jwt = f"{enc({'alg': 'HS256', 'typ': 'JWT'})}.{enc({'sub': '1'})}.c2lnbmF0dXJl"
    der = bytes([0x30, 0x2E, 0x02, 0x01, 0x00, 0x30, 0x05, 0x06, 0x03, 0x2B, 0x65, 0x70, 0x04, 0x22, 0x04, 0x20]) + bytes(32)
    fake = base64.b64encode(bytes([0x30, 0x2E]) + bytes(range(44))).decode()
    text = f"é password=abc123 PASSWD: 'xy' {'a1' * 12} AKIA{'X' * 16} AKIAX {jwt} {base64.b64encode(der).decode()} {fake} eyJhbGciOiJub25l.e30.x"
    spans = secrets.spans_of(text)
    assert [k for k, *_ in spans] == ["assign", "hex", "access", "jwt", "key"]
    assert [text[a:b] for k, a, b in spans if k in ("jwt", "key")] == [jwt, base64.b64encode(der).decode()]
    rows = secrets.digest(secrets.find_secrets(spark.createDataFrame([(1, None), (2, text), (2, text)], "doc_id long, text string"))).collect()
    assert [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in rows] == [(1, 0, 0, 0), (2, 1, 1, 1), (2, 1, 1, 1)]
    assert rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["spans"] == ""


def test_secrets_behind_an_equals_sign_or_in_hexadecimal():
    der = bytes([0x30, 0x2E, 0x02, 0x01, 0x00, 0x30, 0x05, 0x06, 0x03, 0x2B, 0x65, 0x70, 0x04, 0x22, 0x04, 0x20]) + bytes(32)
    part = lambda x: len(x).to_bytes(4, "big") + x
    ssh = b"openssh-key-v1\0" + part(b"none") + part(b"none") + part(b"") + (1).to_bytes(4, "big") + part(bytes(40)) + part(bytes(64))
    fake = bytes([0x30, 0x2E]) + bytes(range(44))
    b64 = lambda x: base64.b64encode(x).decode()
    for before, key in [("PRIVATE_KEY=", b64(der)), ("signing_key=", der.hex()), ("k=0x", der.hex()), ("k 0X", der.hex().upper()), ("x=", ssh.hex()), ("0x", ssh.hex().upper()), ("SSH=", b64(ssh))]:
        text = f"export {before}{key}\n"
        assert [text[a:b] for k, a, b in secrets.spans_of(text) if k == "key"] == [key]
    assert not [k for k, *_ in secrets.spans_of(f"PRIVATE_KEY={b64(fake)} k=0x{fake.hex()}") if k == "key"]


def test_secrets_in_hostile_texts():
    """Many beginnings without an end: each scan stays linear, or this would not end."""
    for text in ("-----BEGIN PRIVATE KEY-----" * 20_000, "eyJ" * 200_000, "eyJa." * 100_000, "M" * 1_000_000, "AKIA" * 100_000, "-" * 1_000_000):
        assert all(kind not in ("jwt", "key", "pem") for kind, *_ in secrets.spans_of(text))


def test_secrets_in_a_block_inside_base64():
    der = b"\x30\x2e\x02\x01\x00\x30\x05\x06\x03\x2b\x65\x70\x04\x22\x04\x20" + bytes(range(32))
    block = f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(der).decode()}\n-----END PRIVATE KEY-----\n"
    inner = base64.b64encode(block.encode()).decode()
    assert ("key", 4, 4 + len(inner)) in secrets.spans_of(f"key {inner} end")
    assert [k for k, *_ in secrets.spans_of(block * 2) if k == "pem"] == ["pem"] * 2


def test_decontamination_on_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "word word word"), (2, None), (3, "..."), (10, "One line only here one LINE only here one line only here"), (11, "absent words")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(odd, bench).collect()}
    assert got[1] == (0, 0, []) and got[3] == (12, 12, ["10"]) and got[5] == (30_000, 30_000, ["1"])
    assert decontaminate.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_url_filter_on_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.NET/en/x?q#f"), (4, "http://example.net"), (5, "http://notnet/"), (6, "http://x.org/fr/"), (6, "http://x.org/fr/")]
    rules = url_filter.listed(spark, (("block", "net", "/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()]
    assert sorted(got, key=str) == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "", None, "allow"),
        (5, "notnet", "/", None, "allow"), (6, "x.org", "/fr/", "org/fr/", "allow"), (6, "x.org", "/fr/", "org/fr/", "allow"),
    ], key=str)
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict != 'allow'").count() == 0


def test_language_id_on_held_out_rows(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out()))
    said = language_id.identify(docs.where(language_id.held_out()), model)
    assert said.where("lang_pred = lang").count() >= 0.97 * said.count() and said.where("rejected").count() == 0
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.identify(odd, model).collect()}
    assert all(got[i] == ("und", True) for i in (1, 2, 4, 6)) and got[3] == ("en", False)
    assert language_id.predict(["Ελληνικά κείμενα και τίποτα άλλο"], model)[0][2]
    assert language_id.predict(["a"], language_id.fit(docs.limit(0)))[0][0] == "und"


def test_license_scan(spark):
    plain = ["The the of words and more text without any grant in line %d here." % i for i in range(60)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(100, "x\nReleased under the MIT License.\ny"), (101, "Licensed under the Apache License, Version 2.0."), (102, None), (103, ""), (104, "All rights reserved."), (101, "Licensed under the Apache License, Version 2.0.")]
    got = [(r["doc_id"], r["families"]) for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100 or n_license > 0").collect()]
    assert sorted(got) == [(100, "mit"), (101, "apache-2.0"), (101, "apache-2.0"), (102, ""), (103, ""), (104, "")]


def test_license_scan_of_wrapped_notices(spark):
    mit = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files, to deal in the", "Software without restriction"]
    gpl = ["This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "any later version."]
    apache = "Licensed under the Apache License, Version 2.0."
    rows = [(i, "The the of words and more text without any grant in line %d here." % i) for i in range(60)]
    rows += [(100, "\n".join(mit)), (101, "/*\n * " + "\n * ".join(gpl) + "\n *\n * more\n */"), (102, "\n\n".join(mit)), (103, f"{apache}\n{apache}"), (104, "\n".join(f"dnl {x}" for x in mit))]
    rows += [(105, "\n".join([apache, "", *mit])), (106, None)]
    got = {r["doc_id"]: (r["n_license"], r["spans"]) for r in license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100 or n_license > 0").collect()}
    assert got == {100: (1, "0-2:mit"), 101: (1, "1-4:gpl-3"), 102: (0, ""), 103: (2, "0:apache-2.0,1:apache-2.0"), 104: (1, "0-2:mit"), 105: (2, "0:apache-2.0,2-4:mit"), 106: (0, "")}


def test_ngram_join_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choice(words, int(rng.integers(30, 200))).tolist()
        for _ in range(8):
            x = list(base)
            for _ in range(int(rng.integers(0, 4))):
                x[int(rng.integers(0, len(x)))] = str(rng.choice(words)).upper()
            rows.append((len(rows), " ".join(x), "en", 0, "x"))
    rows += [(500, "a b", "en", 0, ""), (501, "A\tb", "en", 0, ""), (502, None, "en", 0, ""), (503, " ", "en", 0, ""), (500, "a b", "en", 0, "")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.components(spark.createDataFrame(rows, DOCS)).collect()}

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {d: shingles(t) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert ngram_join.components(spark.createDataFrame([], DOCS)).count() == 0


def _near_copies():
    """Rows (doc_id, text) with null ids and with one id under two texts: a, b and c are texts, a2 a near copy of a."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    text = {k: rng.choice(words, 150).tolist() for k in "abcd"}
    near = lambda k, i: " ".join(text[k][:-i] + [f"x{j}" for j in range(i)]) if i else " ".join(text[k])
    return [(10, near("a", 0)), (10, near("b", 0)), (11, near("a", 1)), (9, near("b", 1)), (None, near("c", 0)), (None, near("c", 1)), (None, near("a", 2)), (None, near("c", 0)), (12, near("d", 0))]


def test_ngram_join_on_null_and_shared_ids(spark):
    rows = _near_copies()
    got = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(10, 10), (10, 9), (11, 10), (9, 9), (None, None), (None, None), (None, 10), (None, None), (12, 12)]
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, want))


def test_pipeline_stages_keep_rows_apart(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, "en", "s", len(t)) for d, t in _near_copies()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == 4 and kept.count((10, rows[0][1])) == 1 and kept.count((9, rows[3][1])) == 1 and kept.count((12, rows[8][1])) == 1
    assert [t in (rows[4][1], rows[5][1]) for d, t in kept if d is None] == [True]
    item = " ".join(rows[0][1].split()[:20])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = sorted(str((r["doc_id"], r["text"])) for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect())
    assert clean == sorted(str((d, t)) for d, t, *_ in rows if item not in t)


def test_pipeline_on_copies(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in docs.collect()}
    hit = {r["doc_id"] for r in QUERIES["op6_decontamination"](spark, SF).where("contaminated").collect()}
    assert not hit & set(ids) or len(hit & set(ids)) < len(hit)

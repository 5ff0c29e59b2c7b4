"""Chat formatting, spelling variants and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleguard.llm import chat_format, fill_middle, spelling

PARTS = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows):
    chats = chat_format.format_chats(spark.createDataFrame(rows, PARTS))
    read = chats.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "learned": chat_format.loss_text(F.col("formatted"), F.col("turn_starts"), F.col("loss"))})
    return {r["conv_id"]: r for r in read.collect()}


def test_parts_become_ordered_placeholders_with_their_attachments(spark):
    rows = [
        (1, 1, "assistant", [part("text", "Seen: "), part("image", ref="b.png", width=28, height=1), part("text", "ok <image> \\l"), part("text", "")]),
        (1, 0, "user", [part("image", ref="a.png", width=57, height=56), part("text", "what?"), part("audio", ref="a.wav", seconds=1.01), part("document", ref="a.pdf", pages=3), part("video", ref="v")]),
    ]
    got = formatted(spark, rows)[1]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 6), ("audio", "a.wav", 26), ("document", "a.pdf", 2100), ("video", "v", 0), ("image", "b.png", 1)]
    assert got["n_tokens"] == 6 + 26 + 2100 + 1
    assert [(t["role"], t["text"], t["placeholders"]) for t in got["turns"]] == [("user", "what?", ["<image>", "<audio>", "<document>", "<other>"]), ("assistant", "Seen: ok <image> \\l", ["<image>"])]
    assert got["formatted"].startswith("<turn:user><image>what?<audio><document><other></turn>\n<turn:assistant>Seen: <image>ok ")
    assert got["learned"] == "Seen: ok <image> \\l"
    spans = [got["formatted"][s["start"] : s["end"]] for s in got["loss"]]
    assert spans == ["Seen: ", "ok \\limage> \\bl"] and "".join(re.findall(chat_format.PLACEHOLDERS, got["formatted"])) == "<image><audio><document><other><image>"


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_and_roles_come_back(spark, seed):
    rng = random.Random(seed)
    pieces = ["<", ">", "\\", "\\l", "\\b", "\\g", "<turn:", "</turn>\n", "\n", "user", "<image>", "é", "😀", "", "$1", "\\E", "### Assistant:"]
    say = lambda: "".join(rng.choices(pieces, k=rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", say()]), [part("text", say()) for _ in range(rng.randrange(3))]) for c in range(20) for t in range(rng.randrange(1, 7))]
    got = formatted(spark, rows)
    for c in range(20):
        mine = [(r, "".join(p[1] for p in ps)) for cc, _, r, ps in rows if cc == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == mine
        assert got[c]["learned"] == "".join(x for r, x in mine if r == "assistant")
        assert [got[c]["formatted"][at:].startswith(chat_format.OPEN) for at in got[c]["turn_starts"]] == [True] * len(mine)


def test_nulls_ties_and_long_turns_of_chats(spark):
    long = "a<b\\" * 100_000
    rows = [(1, 0, None, None), (1, None, "user", [None, part("text"), part(None, "x")]), (2, 5, "user", [part("text", "b")]), (2, 5, "user", [part("text", "a")]), (2, 5, "assistant", [part("text", "c")]), (None, 0, "assistant", [part("text", long)])]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "x"), ("", "")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("assistant", "c"), ("user", "a"), ("user", "b")]
    assert got[None]["learned"] == long and got[None]["loss"][0]["end"] - got[None]["loss"][0]["start"] == 600_000


def test_a_conversation_of_many_turns_is_read_back(spark):
    turns = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), chat_format.text_parts(F.concat(F.lit("say <"), F.col("id").cast("string"))).alias("parts"))
    chats = chat_format.format_chats(turns).select(F.size(chat_format.read_turns(F.col("formatted"))).alias("n"), chat_format.loss_text(F.col("formatted"), F.col("turn_starts"), F.col("loss")).alias("learned"))
    assert tuple(chats.first()) == (20_000, "".join(f"say <{i}" for i in range(1, 20_000, 2)))


def plain_variants(docs, shortest=5, fewest=3):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= shortest and n >= fewest}
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return (len(a) == len(b) + 1 and b in shorter(a)) or (len(b) == len(a) + 1 and a in shorter(b))

    mates = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for w, found in mates.items():
        best = min(found, key=lambda b: (-words[b], b), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(mates[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items())


def mixed_documents(seed):
    """Few stems with random edits, so that many words are near; runs of one letter, long words, Latin-1 letters, hot beginnings."""
    rng, letters = random.Random(seed), "abÀé"
    stems = ["aaaaa", "ababab", "conversation", "éàéàéà", "abcdeabcde", "z" * 400, "bbbbbbb"]
    words = []
    for _ in range(900):
        w = rng.choice(stems)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]])
        words += [w] * rng.choice([1, 2, 3, 4, 9])
    words += [f"stamm{a}{b}{c}" for a in "abcdef" for b in "abcdef" for c in "abc"] * 3
    rng.shuffle(words)
    docs = [(i, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) + rng.choice(["", "1", "-"]) for w in words[i * 50 : i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    return [*docs, (7, None), (None, "conversation conversaton"), (8, ""), docs[0]]


@pytest.mark.parametrize("limit", [20_000, 30, 1])
def test_spelling_variants_equal_brute_force(spark, limit):
    docs = mixed_documents(limit)
    got = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), limit=limit)
    assert sorted(map(tuple, got.select("word", "n", "n_near", "form", "form_n", "root").collect())) == plain_variants(docs)


def test_chains_of_forms_lead_to_the_last(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(20)] + [("x", "w20"), ("y", "w3")]
    roots, _ = spelling.follow(spark.createDataFrame(forms, "word string, form string"))
    assert {tuple(r) for r in roots.collect()} == {(w, "w20") for w, _ in forms}


def test_tries_find_every_pair_of_short_words():
    words = [a + b + c for a in ("", "a", "b") for b in ("", "a", "b") for c in ("", "a", "b", "c")]
    words = sorted(set(words))
    got = sorted((x.word, y.word) for x, y in spelling.near_pairs([(w, w, 1) for w in words]))
    edits = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "abc"} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "abc"}
    assert got == sorted((a, b) for a in words for b in words if a != b and b in edits(a))


def plain_fill(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h4 = int(h[:8], 16), int(h[8:16], 16), int(h[24:32], 16)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_equals_a_plain_version_and_is_undone(spark):
    rng = random.Random(4)
    pieces = ["a\n", "\n", "longer line\r\n", "<", "P>", "<S", ">", "é😀", " x", "end", "<P", "M>"]
    docs = [(i, "".join(rng.choices(pieces, k=rng.randrange(12)))) for i in range(300)] + [(None, "a\nb"), (-5, "x\ny\nz\n"), (3, None), (4, ""), (5, "has <M> inside\nx"), (6, "y\n" * 200_000), (6, "y\n" * 200_000)]
    cut = fill_middle.fill_in_middle(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), seed=7)
    got = cut.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, ((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got))) == sorted(map(str, ((i, *plain_fill(i, t)) for i, t in docs)))
    assert Counter(r["back"] for r in got) == Counter(t or "" for _, t in docs)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rate_leaves_documents_plain_and_other_units_work(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one two  three\nfour").alias("text"))
    cut = fill_middle.fill_in_middle(docs, pattern=r"\S+", seed=1, rate=30, spm_rate=0)
    forms = Counter(r["form"] for r in cut.collect())
    assert 80 < forms["psm"] < 160 and set(forms) == {"plain", "psm"} and cut.where("n != 4").isEmpty()
    assert cut.where(fill_middle.restored(F.col("output"), F.col("form")) != "one two  three\nfour").isEmpty()


def test_the_matcher_stores_no_units():
    units, text = re.compile(fill_middle.LINES), "ab\n" * 300_000
    tracemalloc.start()
    n = fill_middle.count_units(units, text)
    assert fill_middle.ends_after(units, text, 3, n - 1) == (9, 3 * (n - 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and peak < 50_000

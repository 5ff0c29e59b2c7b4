"""Steps whose work must not grow faster than their input."""

import random

from pyspark.sql import functions as F

from tripleguard.llm import html_extract, line_dedup


def test_lines_that_share_a_passage_do_not_meet_however_many_there_are(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    lines = []
    for _ in range(500):
        passage = text(120)
        lines += [text(180) + passage for _ in range(8)]
    near = text(300)
    lines += [near, near[:-4] + "+++"]
    texts = spark.createDataFrame(list(enumerate(lines)), "node long, line string").repartition(8)
    placed = texts.select("node", F.col("node").alias("component"))
    assert [tuple(r) for r in line_dedup.prefix_pairs(placed, texts, 0.8).collect()] == [(4000, 4001)]


def test_marked_articles_are_differenced_too(spark):
    words = ("Alpha", "Bravo", "Carol", "Delta", "Eagle")
    shared = "Two of the articles quote this sentence from the report."
    page = lambda i: f"<html><body><article><p>{words[i]} stands in this article alone.</p>{f'<p>{shared}</p>' if i < 2 else ''}<p>Read more of our stories every single day.</p></article></body></html>"
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(5)] + [(9, "http://b.org/9", page(4))]
    got = {r["page_id"]: r["text"].split("\n") for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = [f"{w} stands in this article alone." for w in words]
    assert got == {i: [own[i]] + [shared] * (i < 2) for i in range(5)} | {9: [own[4], "Read more of our stories every single day."]}

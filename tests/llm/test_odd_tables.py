"""Every query of the subpackage on empty tables, and on tables with columns whose names it may use itself."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripleguard.llm.queries import QUERIES

ALL = {**QUERIES, "pipeline": corpus_pipeline.run}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
CLASHING = (
    "id", "key", "row_key", "row", "rank", "score", "rejected", "lang_pred", "removed", "line", "lines", "line_no", "node", "component", "component_id", "group", "token", "tokens", "set", "n", "w", "words",
    "part", "host", "path", "rule", "verdict", "mate", "marked", "order", "cell", "query_id", "spans", "item", "items", "hits", "n_hit", "held_out", "ids", "at", "first", "src", "dst",
    "parts", "pieces", "segment", "attached", "formatted", "loss", "turns", "no", "head", "word", "near", "near_n", "form", "form_n", "root", "next", "m", "low", "high", "window", "run", "output", "prefix_chars", "middle_chars",
)
PROSE = [" ".join(f"{word}{i}" for i in range(12 * n, 12 * n + 30)) for n, word in enumerate(("river", "mountain", "garden", "window"))]
ROWS = {
    "documents": [
        (1, PROSE[0] + "\n" + PROSE[1], "en", "a", 1), (2, PROSE[0] + "\n" + PROSE[1], "en", "a", 1), (3, PROSE[2] + "\nMIT License\ntoken=abcdef123456", "de", None, 2), (3, PROSE[3], None, "b", 3),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (None, PROSE[1] + " AKIA" + "B" * 20, "fr", "a", 4), (6, " \n\n ", "fr", "a", 4), (7, "x" * 3000, "en", "a", 5),
    ],
    "pages": [
        (1, "https://a.net/x/1", f"<article><p>{PROSE[0]}</p></article>"), (2, "https://a.net/x/2", f"<div>Top of all pages</div><p>{PROSE[1]}</p>"), (3, "https://a.net/x/3", f"<div>Top of all pages</div><p>{PROSE[2]}</p>"),
        (3, "https://a.net/x/3", f"<div>Top of all pages</div><p>{PROSE[2]}</p>"), (4, None, None), (None, "none", "plain"),
    ],
    "benchmark": [(1, PROSE[3]), (2, None), (3, "")],
    "conversations": [(1, 1, "assistant", PROSE[1]), (1, 0, "user", PROSE[0]), (1, 1, "assistant", PROSE[1]), (2, None, None, None), (None, 0, "user", "<turn:a></turn>\n"), (3, 0, "assistant", "")],
    "embeddings": [*((i, [float(i % 7), float(i % 5) - 2, 1.0, float(i % 3)], 0) for i in range(45)), (45, None, 1), (46, [0.0, 0.0, 0.0, 0.0], 1), (20, [float("nan"), 1.0, 1.0, 1.0], 1), (47, [1.0, 2.0, 1.0, 1.0], 1), (48, [1.0, 2.0, 1.0, 1.0], 1)],
}


def tables(spark, folder, rows, more=()):
    for name, schema in SCHEMAS.items():
        table = spark.createDataFrame(rows.get(name, []), schema).coalesce(2)
        own = {c.lower() for c in table.columns}
        extra = [F.lit(f"{name}-{c}").alias(c) for c in more if c not in own]
        table.select(*extra, *table.columns).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {kind: tables(spark, tmp_path_factory.mktemp(kind), *given) for kind, given in (("none", ({},)), ("plain", (ROWS,)), ("clash", (ROWS, CLASHING)))}


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables_give_no_rows(spark, folders, name):
    rows = ALL[name](spark, folders["none"]).collect()
    assert [r["conv_id"] for r in rows] == [-7] if name == "op11_chat_format" else rows == []


@pytest.mark.parametrize("name", sorted(ALL))
def test_other_columns_change_nothing(spark, folders, name):
    want, got = (ALL[name](spark, folders[kind]) for kind in ("plain", "clash"))
    same = [c for c in want.columns if c in got.columns]
    assert same == want.columns and want.count() > 0
    assert sorted(map(str, got.select(*same).collect())) == sorted(map(str, want.collect()))


def test_ties_of_equal_vectors_go_to_the_smaller_id(spark, folders):
    found = QUERIES["op2_multi_index"](spark, folders["plain"])
    for query in (r["query_id"] for r in found.select("query_id").distinct().collect()):
        rows = found.where(F.col("query_id") == query).orderBy("rank").collect()
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert rows == sorted(rows, key=lambda r: (-r["score"], r["vec_id"]))
        assert query not in {r["vec_id"] for r in rows} and not {45, 46} & {r["vec_id"] for r in rows}

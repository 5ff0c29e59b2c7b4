"""The licence classifier learns from every line of every text."""

from pyspark.sql import functions as F

from tripleguard.llm import license_scan


def test_all_lines_are_learnt_from(spark):
    """3,000 documents, each with a line that shares a word pair with templates, and one of them with a line of its own."""
    line = F.concat(F.lit("the word "), F.col("id").cast("string"), F.lit(" stands\nin the work "), F.col("id").cast("string"))
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 1_234, F.concat(line, F.lit("\nto any house"))).otherwise(line).alias("text"))
    known = license_scan.templates(spark)
    kinds = {tuple(r["grams"]): r["n"] for r in license_scan.line_kinds(license_scan.vocabulary_in_lines(docs, known, "doc_id", "text")).collect()}
    assert sum(kinds.values()) == 3_000 + 1 and kinds[("to any",)] == 1
    held = license_scan.vocabulary_in_lines(docs, known, "doc_id", "text")
    rows = license_scan._training_rows(known, docs, held, "text")[0].where("family = 'unknown'").select("grams", "weight", "calibrates").collect()
    assert {tuple(r["grams"]) for r in rows} >= {*kinds, ()}  # also those of one document
    assert max(r["weight"] for r in rows) <= license_scan.MASS or any(r["calibrates"] for r in rows)
    assert license_scan.license_report(docs).where("n_license > 0").isEmpty()

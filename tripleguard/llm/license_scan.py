"""Licence scan by a trained paragraph classifier. DataFrame operations only.

Paragraphs are the lines of a text and, for wrapped notices, spans of lines: runs of consecutive lines that each hold
an n-gram of the vocabulary, which may reach over line ends but not over a line without words (a blank one
or one of comment marks only). A span counts where none of its lines gives the same family by itself. A multinomial logistic regression over the presence of word bigrams and trigrams (the
vocabulary is that of the templates) names a licence family or `unknown`. It is trained here, on
variants of the templates (words left out by a rule) and on all lines of the corpus that grant nothing as the unknown class:
those that share no word pair with a template, and those that share some, but less than HARD of any template. Lines that
hold the same n-grams of the vocabulary are one row with their number as weight; each of both kinds weighs MASS at most in all, so that
a large corpus doesn't drown the notices.
Half of the rows that share some only calibrate: a family must beat the probability that no calibrating
line reaches. A prediction is reported once a template of its family confirms it: the paragraph must hold at least
CONFIRM of the template's n-grams.

Training and scoring cover every line of every text. Defined results: null and empty texts have
no paragraphs and no licences; each row gets a row; repeated paragraphs each count; ties between templates go to
the smaller name; further columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleguard.llm.shared import remove, written

#: Weight of each kind of unknown lines in the fit, at most.
MASS = 1_000
VARIANTS = 12
CONFIRM = 0.6
#: A line that shares less than this part of every template grants nothing; a family is never named below the probability LEAST.
HARD, LEAST = 0.3, 0.5
UNKNOWN = "unknown"
#: Comment marks that are words; others go with all that isn't a letter or a digit.
COMMENT_WORD = r"(?i)^\s*(?:@?rem|dnl)(?=\s|$)"

# Customary notices by family.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("agpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2."),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "MIT License"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
# Lines that speak of rights or licences without granting any.
NEAR_MISSES = (
    "All rights reserved.",
    "Copyright by the author.",
    "The driver held a valid license and was released.",
    "Version 2.0 of the file was published under the old name.",
    "Licensed under the terms of a separate agreement.",
    "The general public is free to use the library under the supervision of the staff.",
    "A license is required to fish in this work area.",
    "Permission is required before any person may enter the software laboratory.",
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def grams(rows: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """keys and gram for each bigram and trigram of the words."""
    at = rows.select(*keys, words, F.posexplode(words).alias("i", "first"))
    two = F.concat_ws(" ", "first", F.get(F.col(words), F.col("i") + 1))
    three = F.concat_ws(" ", two, F.get(F.col(words), F.col("i") + 2))
    left = F.size(words) - F.col("i")
    both = F.array(F.when(left >= 2, two), F.when(left >= 3, three))
    return at.select(*keys, F.explode(both).alias("gram")).where("gram is not null")


def grams_in_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row_key, first, last, gram: each bigram and trigram, and the lines in which it begins and ends."""
    marked = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.transform(words_of(F.regexp_replace(line, COMMENT_WORD, "")), lambda w: F.struct(w.alias("word"), i.alias("line"))))
    rows = docs.select(F.xxhash64(doc_id, text).alias("row_key"), F.flatten(marked).alias("words"))
    at = rows.select("row_key", "words", F.posexplode("words").alias("i", "one"))
    two, three = (F.get(F.col("words"), F.col("i") + k) for k in (1, 2))
    near = two["line"] - F.col("one.line") <= 1
    gram = lambda last, *words: F.struct(last["line"].alias("last"), F.concat_ws(" ", F.col("one.word"), *(w["word"] for w in words)).alias("gram"))
    both = F.array(F.when(near, gram(two, two)), F.when(near & (three["line"] - two["line"] <= 1), gram(three, two, three)))
    return at.select("row_key", F.col("one.line").alias("first"), F.explode(both).alias("g")).where("g is not null").select("row_key", "first", "g.last", "g.gram")


def candidates(held: DataFrame) -> DataFrame:
    """row_key, paragraph (struct of first and last line), gram: each line, and each span of lines that hold grams. held: row_key, first, last, gram."""
    lines = held.where("first = last").select("row_key", F.struct("first", "last").alias("paragraph"), "gram")
    inside = Window.partitionBy("row_key").orderBy("first")
    before = F.max("last").over(inside.rangeBetween(Window.unboundedPreceding, -1))
    starts = held.withColumn("begins", F.when(before.isNull() | (F.col("first") > before + 1), F.col("first")))
    island = starts.withColumn("island", F.max("begins").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    end = F.max("last").over(Window.partitionBy("row_key", "island"))
    spans = island.withColumn("end", end).where("island < end").select("row_key", F.struct(F.col("island").alias("first"), F.col("end").alias("last")).alias("paragraph"), "gram")
    return lines.unionByName(spans.distinct())


def templates(spark: SparkSession) -> DataFrame:
    """template (number), family, words."""
    return spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string").select("template", "family", words_of(F.col("text")).alias("words"))


def vocabulary_in_lines(docs: DataFrame, known: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row_key, first, last, gram: what grams_in_lines() finds of the templates' n-grams."""
    return grams_in_lines(docs, doc_id, text).join(F.broadcast(grams(known, []).distinct()), "gram", "left_semi").select("row_key", "first", "last", "gram").distinct()


def line_kinds(held: DataFrame) -> DataFrame:
    """grams and n: how many lines hold just these n-grams of the vocabulary. held: row_key, first, last, gram."""
    lines = held.where("first = last").groupBy("row_key", "first").agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    return lines.groupBy("grams").agg(F.count(F.lit(1)).alias("n"))


def _training_rows(known: DataFrame, docs: DataFrame, held: DataFrame, text: str) -> tuple[DataFrame, list[str]]:
    """id, family, calibrates, weight, grams: variants of the templates, near misses and the corpus's lines that grant nothing; and the folders they depend on."""
    spark = known.sparkSession
    variant = known.select("family", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS))).alias("v"), "template", "words")
    left_out = F.filter("words", lambda w, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(F.lit("leave"), "v", "template", i), F.lit(9)) > 0))
    near = spark.createDataFrame([(UNKNOWN, t) for t in NEAR_MISSES] * VARIANTS, "family string, text string").select("family", words_of(F.col("text")).alias("words"))
    given, given_at = written(variant.select("family", left_out.alias("words")).unionByName(near).withColumn("id", F.monotonically_increasing_id()))  # the ids are fixed by the write
    own = given.select("family", F.lit(False).alias("calibrates"), F.lit(1.0).alias("weight"), "id").join(grams(given, ["id"]).groupBy("id").agg(F.collect_set("gram").alias("grams")), "id").drop("id")

    kinds, kinds_at = written(line_kinds(held))
    of_template = grams(known, ["template"]).distinct()
    sizes = of_template.groupBy("template").agg(F.count(F.lit(1)).alias("size"))
    common = kinds.select("grams", F.explode("grams").alias("gram")).join(F.broadcast(of_template), "gram").groupBy("grams", "template").agg(F.count(F.lit(1)).alias("common"))
    granting = common.join(F.broadcast(sizes), "template").where(F.col("common") / F.col("size") >= HARD).select("grams").distinct()
    half = (F.pmod(F.xxhash64(F.lit("half"), "grams"), F.lit(2)) == 0).alias("calibrates")
    sharing, sharing_at = written(kinds.join(granting, "grams", "left_anti").select(half, "grams", "n"))
    some = sharing.where("not calibrates").agg(F.sum("n")).first()[0] or 0
    two_words = "[\\p{L}\\p{N}][^\\p{L}\\p{N}]+[\\p{L}\\p{N}]"
    lines = docs.agg(F.sum(F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(two_words))).cast("long"))).first()[0] or 0
    plain = max(0, lines - (kinds.agg(F.sum("n")).first()[0] or 0))
    unknown = sharing.select(F.lit(UNKNOWN).alias("family"), "calibrates", (F.col("n") * F.lit(min(1.0, MASS / max(some, 1)))).alias("weight"), "grams")
    empty = spark.createDataFrame([(UNKNOWN, False, float(min(plain, MASS)), [])], "family string, calibrates boolean, weight double, grams array<string>").where("weight > 0")
    rows, rows_at = written(own.unionByName(unknown).unionByName(empty).withColumn("id", F.monotonically_increasing_id()))
    remove(spark, given_at, kinds_at, sharing_at)
    return rows, [rows_at]


class Classifier:
    """weights: gram and one weight for each class; bias and least probability by class."""

    def __init__(self, weights: DataFrame, classes: list[str], bias: list[float], least: float) -> None:
        self.weights, self.classes, self.bias, self.least = weights, classes, bias, least


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> Classifier:
    """held: what vocabulary_in_lines() finds, if it is at hand."""
    spark = docs.sparkSession
    known = templates(spark)
    vocabulary = sorted(r["gram"] for r in grams(known, []).distinct().collect())  # of the templates
    held = held if held is not None else vocabulary_in_lines(docs, known, doc_id, text)
    rows, rows_at = _training_rows(known, docs, held, text)
    classes = sorted({f for f, _ in TEMPLATES} | {UNKNOWN})
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("family")).cast("double") - 1
    rows = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True).transform(rows.withColumn("label", place))
    rows, features_at = written(rows)  # read by each step of the fit
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.002, maxIter=40, standardization=False).fit(rows.where("not calibrates"))
    matrix = model.coefficientMatrix.toArray()
    weights = spark.createDataFrame([(g, *map(float, matrix[:, i])) for i, g in enumerate(vocabulary)], "gram string, " + ", ".join(f"w{c} double" for c in range(len(classes))))
    bias = [float(b) for b in model.interceptVector]
    classifier = Classifier(weights, classes, bias, 0.5)
    said = probabilities(rows.where("calibrates").select(F.col("id").alias("row_key"), F.lit(0).alias("paragraph"), F.explode("grams").alias("gram")), classifier)
    top = said.where(F.col("family") != UNKNOWN).agg(F.max("probability")).first()[0]
    classifier.least = max(LEAST, top or 0.0)
    remove(spark, *rows_at, features_at)
    return classifier


def probabilities(held: DataFrame, classifier: Classifier) -> DataFrame:
    """row_key, paragraph, family, probability of each paragraph with a gram of the vocabulary. held: row_key, paragraph, gram."""
    sums = held.join(F.broadcast(classifier.weights), "gram").distinct().groupBy("row_key", "paragraph").agg(*(F.sum(f"w{c}").alias(f"w{c}") for c in range(len(classifier.classes))))
    scores = F.array(*(F.col(f"w{c}") + F.lit(b) for c, b in enumerate(classifier.bias)))
    best = F.array_max("scores")
    return sums.select("row_key", "paragraph", scores.alias("scores")).select(
        "row_key",
        "paragraph",
        F.get(F.array(*map(F.lit, classifier.classes)), F.array_position("scores", best).cast("int") - 1).alias("family"),
        (F.lit(1.0) / F.aggregate("scores", F.lit(0.0), lambda total, s: total + F.exp(s - best))).alias("probability"),
    )


def scan(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text", held: DataFrame | None = None) -> DataFrame:
    """row_key, paragraph, family, probability, template, share of each confirmed paragraph (first and last line)."""
    known = templates(docs.sparkSession)
    of_template = grams(known, ["template", "family"]).distinct()
    sizes = of_template.groupBy("template").agg(F.count(F.lit(1)).alias("size"))
    held = candidates(held if held is not None else written(vocabulary_in_lines(docs, known, doc_id, text))[0])
    said = probabilities(held, classifier).where(F.col("family") != UNKNOWN).where(F.col("probability") > classifier.least)
    compared = (
        held.join(said, ["row_key", "paragraph"])
        .join(F.broadcast(of_template), ["gram", "family"])
        .groupBy("row_key", "paragraph", "family", "probability", "template")
        .agg(F.count(F.lit(1)).alias("common"))
        .join(F.broadcast(sizes), "template")
        .withColumn("share", F.col("common") / F.col("size"))
        .where(F.col("share") >= CONFIRM)
    )
    best = F.min(F.struct((-F.col("share")).alias("far"), "template", "share")).alias("best")
    found, _ = written(compared.groupBy("row_key", "paragraph", "family", "probability").agg(best).select("row_key", "paragraph", "family", "probability", "best.template", "best.share"))
    lines = found.where("paragraph.first = paragraph.last")
    own = lines.select("row_key", "family", F.col("paragraph.first").alias("line"))
    inside = (F.col("s.row_key") == F.col("o.row_key")) & (F.col("s.family") == F.col("o.family")) & F.col("line").between(F.col("s.paragraph.first"), F.col("s.paragraph.last"))
    return lines.unionByName(found.where("paragraph.first < paragraph.last").alias("s").join(own.alias("o"), inside, "left_anti"))


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_license (paragraphs), families (sorted, comma-joined), spans (line:family or first-last:family, by line) for each row."""
    held, _ = written(vocabulary_in_lines(docs, templates(docs.sparkSession), doc_id, text))  # read by both
    found = scan(docs, train(docs, doc_id, text, held), doc_id, text, held)
    per_row = found.groupBy("row_key").agg(
        F.count(F.lit(1)).alias("n_license"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.array_sort(F.collect_list(F.struct("paragraph", "family"))).alias("spans")
    )
    place = lambda p: F.when(p["first"] == p["last"], p["first"].cast("string")).otherwise(F.concat_ws("-", p["first"], p["last"]))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", place(s["paragraph"]), s["family"])), ",")
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"))
        .join(per_row.select("row_key", "n_license", "families", spans.alias("spans")), "row_key", "left")
        .select("doc_id", F.coalesce("n_license", F.lit(0)).alias("n_license"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("spans", F.lit("")).alias("spans"))
    )

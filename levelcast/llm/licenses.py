"""License scans: units of text against templates by Dice over word bigrams."""

from pyspark.sql import functions as F

from levelcast.llm.common import WORD, lower_ascii
from levelcast.operators.stages import compute_once

# Names and wording of common public notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    (
        "cc-by-4.0",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ),
    ("proprietary", "All rights reserved."),
)
THRESHOLD = 0.8


def bigrams(words):
    """Distinct pairs of neighbouring words; a lone word stands for itself."""
    n = F.size(words)
    pairs = F.transform(
        F.sequence(F.lit(0), n - 2), lambda i: F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))
    )
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(words)


def normal_words(text):
    """Words of letters, digits and dots inside a word, ASCII in lower case."""
    clean = F.regexp_replace(lower_ascii(text), r"[^\p{L}\p{N}.]+", " ")
    return F.array_remove(F.split(F.regexp_replace(clean, r"\.+( |\z)", "$1"), " "), "")


def template_sizes(spark, templates=TEMPLATES, threshold=THRESHOLD):
    """Each template once for every number of bigrams a match can have.

    Dice = 2 common / (a + b) reaches t only for b * t / (2 - t) <= a <= b * (2 - t) / t.
    The table is as long as the templates, whatever the data.
    """
    literals = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("wording")) for name, text in templates]
    rows = spark.range(1).select(F.inline(F.array(*literals)))
    rows = compute_once(rows, words=normal_words(F.col("wording")))
    rows = rows.select("license", bigrams(F.col("words")).alias("pattern"))
    size = F.size("pattern")
    least = F.ceil(size * F.lit(threshold) / F.lit(2 - threshold) - 1e-9).cast("int")
    most = F.floor(size * F.lit(2 - threshold) / F.lit(threshold) + 1e-9).cast("int")
    return rows.withColumn("n_bigrams", F.explode(F.sequence(least, most)))


def units(docs):
    """Every line, every block between blank lines, and the whole text, once each."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    blocks = F.split(text, r"\n[\x20\x09-\x0D]*\n")
    return docs.select(
        "doc_id",
        F.explode(F.array_distinct(F.concat(lines, blocks, F.array(text)))).alias("unit"),
    )


def scan(docs, templates=TEMPLATES, threshold=THRESHOLD):
    """License notices in documents: lines, blocks or whole texts near a template.

    Lower case, punctuation dropped; Dice coefficient of the sets of word pairs,
    `threshold` or more. Only templates whose size allows that are compared: the
    join is on the number of pairs, against the small table of templates.

    Returns doc_id, license, dice (best match of that license), n_matches, one row
    for each document and license found. NULL and empty texts match nothing. Rows
    that share a doc_id are scanned as parts of one document; a NULL doc_id counts
    as one document. Extra columns are ignored.
    """
    found = template_sizes(docs.sparkSession, templates, threshold)
    units_of = units(docs).filter(F.col("unit").rlike(WORD))
    # Words and pairs are steps of their own: inside a lambda an expression is computed per element.
    units_of = compute_once(units_of, words=normal_words(F.col("unit")))
    units_of = compute_once(units_of, keep=["doc_id", "unit"], pairs=bigrams(F.col("words")))
    units_of = units_of.filter(F.size("pairs") > 0).withColumn("n_bigrams", F.size("pairs"))
    joined = units_of.join(F.broadcast(found), "n_bigrams")
    common = F.size(F.array_intersect("pairs", "pattern"))
    dice = common * 2.0 / (F.col("n_bigrams") + F.size("pattern"))
    hits = joined.select("doc_id", "license", "unit", dice.alias("dice")).filter(F.col("dice") >= threshold)
    per_unit = hits.groupBy("doc_id", "license", F.xxhash64("unit").alias("u")).agg(F.max("dice").alias("dice"))
    return per_unit.groupBy("doc_id", "license").agg(
        F.max("dice").alias("dice"), F.count("*").cast("bigint").alias("n_matches")
    )

"""Small tables with the awkward rows every operator must take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names that the operators use inside; a caller may have such columns too.
CLASHING = ("words", "lines", "c", "n", "value", "label", "text_hash", "size", "h", "bucket", "row", "score", "hit", "g_id")


def docs_of(spark, rows, clashing=False):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def prose(seed, n, size=400):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(size)}" for _ in range(n)]
    lines = [" ".join(words[i : i + 9]) + "." for i in range(0, n, 9)]
    return "\n".join(lines)


def awkward(spark, clashing=True):
    """NULL and empty texts, NULL ids and sources, repeated rows, one very long text."""
    long_text = prose(99, 30_000, 5000)
    rows = [
        (1, None), (2, ""), (3, " \n\t\n "), (None, prose(1, 80)), (None, None, None), (4, prose(2, 80), None),
        (5, prose(3, 80)), (5, prose(3, 80)), (6, prose(3, 80)), (7, long_text), (8, "one"), (9, "two words"), (8, "one"),
    ]
    return docs_of(spark, rows, clashing)

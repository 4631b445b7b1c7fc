"""Quality rules, line first: failing lines go, then documents that lost too much."""

from pyspark.sql import functions as F

from levelcast.llm.common import GAP, WORD, words_of
from levelcast.operators.stages import compute_once

SYMBOLS = "#*$%&|<>"
# Marks that running prose uses sparingly; a line full of them is decoration.
MARKS = "!?#*$%&|<>=~^_+{}\\@"
SEPARATORS = "|»›•·>"
ENDING = r"[.!?:;,…\"'”’»)\]。！？]" + r"[\x20\x09-\x0D]*\z"
BOILERPLATE = (
    r"(?i)(accept (all )?cookies|uses cookies|cookie (policy|settings)|privacy policy|terms of (use|service)"
    r"|all rights reserved|click here|read more|sign (in|up) (to|for|now)|subscribe (to|now)|skip to (main )?content"
    r"|enable javascript|javascript (is|must be)|lorem ipsum|share (this|on) |back to top|powered by |add to cart)"
)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 40
MAX_MARK_PERCENT = 10
MIN_SEPARATORS = 3


def has_word(line):
    return line.rlike(WORD)


def without(text, characters):
    return F.length(F.translate(text, characters, ""))


def unpunctuated(line):
    """No closing punctuation, or so many marks that they are decoration."""
    solid = F.length(F.regexp_replace(line, GAP, ""))
    marks = F.length(line) - without(line, MARKS)
    return ~line.rlike(ENDING) | (marks * 100 > solid * MAX_MARK_PERCENT)


def navigation(line):
    """A row of short entries between separators."""
    return (F.length(line) - without(line, SEPARATORS)) >= MIN_SEPARATORS


def boilerplate(line):
    return line.rlike(BOILERPLATE)


def line_fails(line):
    return has_word(line) & (unpunctuated(line) | navigation(line) | boilerplate(line))


def _sorted_windows(windows):
    """(hash, position) of the windows in order, and none where all of them differ."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    differ = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(differ, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(pairs)


def _repeated_words():
    """How many word positions lie in a 3-word window whose words occur twice or more.

    Windows are compared by 64-bit hash: equal ones are neighbours in `pairs`.
    """
    pairs = F.col("pairs")
    starts = F.sort_array(
        F.transform(
            F.filter(
                F.arrays_zip(
                    pairs.alias("p"),
                    F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(pairs, 1, F.size(pairs) - 1)).alias("b"),
                    F.slice(pairs, 2, F.size(pairs)).alias("a"),
                ),
                lambda z: (z["p"]["h"] == z["b"]["h"]) | (z["p"]["h"] == z["a"]["h"]),
            ),
            lambda z: z["p"]["i"],
        )
    )
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return F.when(F.size("pairs") == 0, F.lit(0)).otherwise(covered)


def measure(docs, keep=()):
    """Base counts and cleaned text of every document, NULL texts as ''; `row` holds the columns of `keep`."""
    text = F.col("text")
    rows = [F.struct(*keep).alias("row")] if keep else []
    step = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), *rows)
    # Steps of their own: a filter on a result must not compute words and windows again.
    step = compute_once(step, words=words_of(text), lines=F.split(text, "\n"))
    n = F.size("words")
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    step = compute_once(
        step,
        windows=F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(
            F.array().cast("array<bigint>")
        ),
        worded=F.filter("lines", has_word),
        good=F.filter("lines", lambda line: ~line_fails(line)),
    )
    step = compute_once(step, pairs=_sorted_windows(F.col("windows")))
    return step.select(
        "doc_id",
        "text",
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words().cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("bigint").alias("n_removed_lines"),
        F.array_join("good", "\n").alias("clean_text"),
        *(["row"] if keep else []),
    )


def clean_lines(docs, max_lost_percent=MAX_LOST_PERCENT, keep=()):
    """Remove failing lines from every text, then judge what is left.

    A line with a word fails when it lacks closing punctuation or is mostly
    marks, is a row of entries between separators, or holds a boilerplate
    phrase. A document is rejected when it fails the base counts (under 50
    words; more than half of its words in repeated 3-word windows) or loses more
    than `max_lost_percent` of its characters.

    Returns doc_id, the counts, clean_text, lost_chars, base_failed and kept, one
    row per input row. NULL and empty texts have no words, fail the base counts
    and have clean_text ''. Repeated rows are judged alike, a NULL doc_id is
    carried through, and further columns of `docs` are ignored, unless `keep` names
    columns to carry along in a struct `row`.
    No row is shuffled: the work of a row depends on its own text only.
    """
    lost = (F.length("text") - F.length("clean_text")).cast("bigint")
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    measured = measure(docs, keep).withColumn("lost_chars", lost).withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.length("text") * max_lost_percent)
    return measured.withColumn("kept", kept).drop("text")

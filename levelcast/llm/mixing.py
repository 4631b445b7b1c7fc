"""Mixing sources to target weights along a curriculum that changes over training."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from levelcast.llm.common import count_words, materialize, stable_hash

WEIGHTS = (5, 2, 1)
# Weight of a source at the start, middle and end of training, by place in WEIGHTS.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
MAX_PASSES = 3
# Positions of the order hash: 16 ** 15.
HASH_RANGE = 1 << 60


def source_targets(sized, weights=WEIGHTS, schedules=SCHEDULES, max_passes=MAX_PASSES):
    """Words to take from each source: its weight's share, capped, the excess reshared.

    The level of the shares is found in closed form: with sources in order of
    cap / weight, the level when the first i are capped is (all words - their
    caps) / (weights of the rest), and the right level is the largest of these.
    One row per source; the windows see that small table only.
    """
    picked = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("rank") - 1) % len(values))
    knots = F.array(*[F.array(*[F.lit(float(w)) for w in s]) for s in schedules])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("rank", F.row_number().over(order))
    sources = sources.withColumn("weight", picked(weights).cast("bigint"))
    sources = sources.withColumn("knots", F.get(knots, (F.col("rank") - 1) % len(schedules)))
    sources = sources.withColumn("cap", F.col("source_size") * max_passes)
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    open_words = F.sum("source_size").over(everything) - F.coalesce(before, F.lit(0))
    sources = sources.withColumn("level", open_words.cast("double") / rest)
    sources = sources.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return sources.withColumn("target", target).select(
        "source", "source_size", "target", F.round("target").cast("bigint").alias("take"), "knots"
    )


def invert_demand(share, knots):
    """The training time (0 to 1) at which a source has delivered `share` of its words.

    `knots` are its weights at evenly spaced times, linear between them. Their
    integral is summed knot by knot; inside the right segment the demand is a
    quadratic, solved in the form that has no division by a zero slope.
    """
    steps = F.size(knots) - 1
    areas = F.transform(F.sequence(F.lit(1), steps), lambda i: (F.get(knots, i - 1) + F.get(knots, i)) / 2.0)
    totals = F.aggregate(
        areas,
        F.array(F.lit(0.0)),
        lambda acc, a: F.concat(acc, F.array(F.element_at(acc, -1) + a)),
    )
    need = share * F.element_at(totals, -1)
    segment = F.least(F.size(F.filter(totals, lambda c: c <= need)), steps) - 1
    left, right = F.get(knots, segment), F.get(knots, segment + 1)
    missing = need - F.get(totals, segment)
    root = F.sqrt(F.greatest(left * left + (right - left) * missing * 2.0, F.lit(0.0)))
    into = F.when(missing <= 0, 0.0).otherwise(missing * 2.0 / (left + root))
    return (segment + into) / steps


def sizes(docs):
    """(doc_id, source, text hash, order hash, size, copies): the narrow table the plan is made from."""
    narrow = docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_hash"),
        count_words(F.col("text")).alias("each"),
        stable_hash(F.col("doc_id")).alias("h"),
    )
    rows = narrow.groupBy("doc_id", "source", "text_hash", "each", "h").agg(F.count("*").alias("copies"))
    return rows.withColumn("size", F.col("each") * F.col("copies"))


def plan_rows(docs, weights=WEIGHTS, schedules=SCHEDULES, max_passes=MAX_PASSES):
    """The plan, one row for each group of equal rows; see plan_mix."""
    sized = materialize(sizes(docs), "mix-sizes")
    buckets = max(1, math.isqrt(sized.count()))
    bucket = F.floor(F.col("h") / F.lit(HASH_RANGE // buckets + 1)).cast("bigint")
    sized = sized.withColumn("bucket", bucket)
    targets = source_targets(sized, weights, schedules, max_passes)
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("bucket_before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    facts = materialize(
        per_bucket.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
            F.col("b.source").alias("b_source"), F.col("bucket").alias("b_bucket"), "bucket_before",
            "source_size", "target", "take", "knots",
        ),
        "mix-buckets",
    )
    within = Window.partitionBy("source", "bucket").orderBy("h", F.col("doc_id").asc_nulls_last(), "each", "text_hash")
    inside = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = sized.withColumn("inside", inside).join(
        facts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket"))
    )
    whole = F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(F.lit(0))
    rest = F.when(F.col("source_size") > 0, F.col("take") % F.col("source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("before", F.col("bucket_before") + F.col("inside"))
    placed = placed.withColumn("passes", whole.cast("bigint"))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    placed = placed.withColumn("cut_words", F.floor(cut / F.col("copies")).cast("bigint"))
    return placed.withColumn("taken", F.col("each") * F.col("passes") + F.col("cut_words"))


def training_time(number, words):
    """Training time of the middle of reading `number` (0 for the first) of a row."""
    offset = F.col("before") + number * F.col("source_size")
    return invert_demand((offset + words / 2.0) / F.col("take"), F.col("knots"))


def plan_mix(docs, weights=WEIGHTS, schedules=SCHEDULES, max_passes=MAX_PASSES):
    """How many words of every document the mix takes, and when it is first read.

    Each source is read in hash order, whole passes first; the last pass ends at
    the word where the target is met, so at most one document per source is cut.
    `position` is the training time of the middle of the first reading, NULL for
    documents that are not taken. Rows come sorted by it, in range partitions.

    Running totals are taken in two steps: over about sqrt(rows) hash buckets of
    a source, then inside (source, bucket), so no task holds a whole source.

    Returns doc_id, source, size, source_size, target, taken, passes, cut_words,
    position, one row per input row. NULL text has size 0, NULL source is a
    source of its own and the last one, a NULL doc_id hashes like ''. Rows equal
    in doc_id, source and text share the words cut from them evenly. An empty
    table gives an empty plan. Extra columns are ignored.
    """
    rows = plan_rows(docs, weights, schedules, max_passes)
    first = F.when(F.col("passes") > 0, F.col("each")).otherwise(F.col("cut_words"))
    position = F.when(F.col("taken") > 0, training_time(F.lit(0), first))
    rows = rows.withColumn("position", position).withColumn("one", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.orderBy(F.col("position").asc_nulls_last(), "before", "doc_id").select(
        "doc_id", "source", F.col("each").alias("size"), "source_size", "target", "taken", "passes", "cut_words", "position"
    )


def first_words(text, n):
    """A text up to the end of its n-th word, spacing kept; '' for n = 0."""
    spaced_words = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(n > 0, F.array_join(F.slice(spaced_words, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")).otherwise("")


def apply_mix(docs, weights=WEIGHTS, schedules=SCHEDULES, max_passes=MAX_PASSES):
    """The mixed corpus: every reading of every document as a row, in training order.

    A document comes once per whole pass and, where its source's last pass ends
    inside it, once more cut after that word, with `n_chars` of the cut text.
    Documents of no words are never read. Rows keep the columns of `docs`.
    """
    rows = plan_rows(docs, weights, schedules, max_passes).filter(F.col("taken") > 0).select(
        *[F.col(c).alias(f"__{c}") for c in ("doc_id", "source", "text_hash")],
        "before", "source_size", "take", "knots", "each", "passes", "cut_words",
    ).select(
        "__doc_id", "__source", "__text_hash", F.col("before").alias("__before"),
        F.explode(
            F.concat(
                F.when(
                    F.col("passes") > 0,
                    F.transform(
                        F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("passes"), F.lit(1)) - 1),
                        lambda k: F.struct(training_time(k, F.col("each")).alias("at"), F.lit(-1).cast("bigint").alias("cut")),
                    ),
                ).otherwise(F.array().cast("array<struct<at:double,cut:bigint>>")),
                F.when(
                    F.col("cut_words") > 0,
                    F.array(F.struct(training_time(F.col("passes"), F.col("cut_words")).alias("at"), F.col("cut_words").alias("cut"))),
                ).otherwise(F.array().cast("array<struct<at:double,cut:bigint>>")),
            )
        ).alias("__reading"),
    )
    joined = docs.withColumn("__hash", F.xxhash64("text")).join(
        rows,
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__hash") == F.col("__text_hash")),
    )
    cut = F.col("__reading.cut")
    text = F.when(cut < 0, F.col("text")).otherwise(first_words(F.col("text"), cut))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut < 0, F.col("n_chars")).otherwise(F.length(text).cast("bigint"))
    ordered = joined.orderBy("__reading.at", "__before", "__doc_id")
    return ordered.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])

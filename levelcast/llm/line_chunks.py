"""Line dedup by content-defined chunks of lines, and by whole repeated passages."""

from pyspark.sql import functions as F

from levelcast.llm.common import WORD, materialize, stable_hash
from levelcast.operators.stages import compute_once

WINDOW = 2  # lines the boundary hash looks at
DIVISOR = 3  # a line ends a chunk with probability 1 / DIVISOR
BASE, PRIME = 1_000_003, 2_147_483_647


def chunk_lines(docs, window=WINDOW, divisor=DIVISOR, keep=()):
    """Each document once with its chunks: arrays of neighbouring lines.

    A polynomial hash rolls over the hashes of the last `window` lines. Where it
    is divisible, the chunk ends. The choice looks at those lines only, so the
    same passage is cut the same way wherever it stands.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # Steps of their own: inside a lambda an expression would be computed for every element.
    step = docs.select("doc_id", *keep, F.xxhash64("text").alias("text_hash"), F.inline(F.array(F.struct(lines.alias("lines")))))
    hashes = F.transform("lines", lambda line: stable_hash(line) % F.lit(PRIME))
    step = compute_once(step, hashes=hashes)

    def rolled(i):
        total = F.get("hashes", i)
        for back in range(1, window):
            older = F.coalesce(F.get("hashes", i - back), F.lit(0))
            total = F.pmod(total + F.pmod(older * F.lit(pow(BASE, back, PRIME)), F.lit(PRIME)), F.lit(PRIME))
        return total

    last = F.size("lines") - 1
    ends = F.filter(
        F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(rolled(i), F.lit(divisor)) == 0)
    )
    step = compute_once(step, ends=ends)
    chunks = F.transform(
        "ends",
        lambda end, k: F.slice(
            "lines",
            F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 2,
            end - F.coalesce(F.get("ends", k - 1), F.lit(-1)),
        ),
    )
    return compute_once(step, keep=["doc_id", "text_hash", *keep, "lines"], chunks=chunks)


def repeated_chunks(docs, window=WINDOW, divisor=DIVISOR):
    """(doc_id, text_hash, found): per document its chunks of two lines or more that stand elsewhere too.

    `found` holds (chunk, digest, original): the number of the chunk, its 128-bit
    digest, and whether this is its first place. Only digests and places are shuffled;
    the places of a hot chunk are joined to one row, which leaves the join free to
    split them.
    """
    exploded = chunk_lines(docs, window, divisor).select(
        "doc_id", "text_hash", F.posexplode("chunks").alias("chunk", "lines")
    )
    several = exploded.filter((F.size("lines") >= 2) & F.exists("lines", lambda line: line.rlike(WORD)))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "chunk")
    digest = F.unhex(F.md5(F.array_join("lines", "\n")))
    places = materialize(several.select(digest.alias("digest"), place.alias("place")), "chunk-places")
    first = places.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    # A row repeated as a whole is one place; it has nothing earlier to give way to.
    first = first.filter("first <> last").select(F.col("digest").alias("f_digest"), "first")
    first = materialize(first, "chunk-firsts")
    repeated = places.join(first, F.col("digest") == F.col("f_digest"))
    original = (F.col("place") == F.col("first")).alias("original")
    repeated = repeated.select("place.doc_id", "place.text_hash", F.struct("place.chunk", "digest", original).alias("x"))
    return repeated.groupBy("doc_id", "text_hash").agg(F.collect_set("x").alias("found"))


def differing_chunks(marked, window=WINDOW, divisor=DIVISOR):
    """(doc_id, text_hash, differ): chunks of `found` whose bytes are not those of their first place."""
    chunked = chunk_lines(marked.filter("found IS NOT NULL"), window, divisor, keep=("found",))
    body = F.array_join(F.get("chunks", F.col("x.chunk")), "\n").alias("body")
    bodies = chunked.select("doc_id", "text_hash", "chunks", F.explode("found").alias("x"))
    bodies = bodies.select("doc_id", "text_hash", "x.chunk", "x.digest", "x.original", body)
    originals = bodies.filter("original").select(F.col("digest").alias("o_digest"), F.col("body").alias("o_body"))
    # Written, so that the join below can split the places of a hot chunk.
    originals = materialize(originals.dropDuplicates(["o_digest"]), "chunk-originals")
    later = bodies.filter("NOT original").join(originals, F.col("digest") == F.col("o_digest"))
    differ = later.filter("body <> o_body").groupBy("doc_id", "text_hash").agg(F.collect_set("chunk").alias("differ"))
    return materialize(differ.withColumnsRenamed({"doc_id": "d_id", "text_hash": "d_hash"}), "chunk-differences")


def dedup_lines(docs, window=WINDOW, divisor=DIVISOR):
    """Remove every multi-line chunk that stands earlier in the corpus.

    The first place of a chunk, by doc_id (NULL last), text hash and position,
    stays. Chunks of one line, and chunks without any word, always stay.

    Returns doc_id, clean_text, n_lines, n_removed_lines, n_removed_chunks, one row
    per input row. A NULL or empty text is one empty line and stays ''. Rows equal
    in doc_id and text are one place and are cleaned alike. Extra columns are
    ignored; an empty table gives an empty result.
    """
    found = repeated_chunks(docs, window, divisor).withColumnsRenamed({"doc_id": "g_id", "text_hash": "g_hash"})
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    # The one shuffle of whole texts. `found` grows with the corpus: merged at every size.
    marked = texts.join(
        found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left"
    )
    marked = materialize(marked.select("doc_id", "text", "text_hash", "found"), "chunk-texts")
    # Equal digests of different bytes are next to none: only those are joined back.
    differ = differing_chunks(marked, window, divisor)
    joined = marked.join(
        differ, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("text_hash") == F.col("d_hash")), "left"
    )
    none = F.array().cast("array<int>")
    differs = F.coalesce("differ", none)
    gone = F.filter("found", lambda x: ~x["original"] & ~F.array_contains(differs, x["chunk"]))
    gone = F.coalesce(F.transform(gone, lambda x: x["chunk"]), none)
    chunked = chunk_lines(joined.select("doc_id", "text", gone.alias("gone")), window, divisor, keep=("gone",))
    kept = F.filter("chunks", lambda _, k: ~F.array_contains("gone", k))
    chunked = chunked.withColumn("kept", F.flatten(kept))
    return chunked.select(
        "doc_id",
        F.array_join("kept", "\n").alias("clean_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed_lines"),
        F.size("gone").cast("bigint").alias("n_removed_chunks"),
    )


def line_pairs(docs):
    """(doc_id, text_hash, start, end, digest) of every two neighbouring lines with a word.

    A pair reaches from its first line to its second, over lines without a word
    between them; SHA-256 of that stretch stands for its bytes.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    step = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("lines"))
    step = compute_once(step, worded=F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.get("lines", i).rlike(WORD)))
    ends = F.slice("worded", 2, F.greatest(F.size("worded") - 1, F.lit(0)))
    step = step.select("doc_id", "text_hash", "lines", F.inline(F.arrays_zip(F.col("worded").alias("start"), ends.alias("end"))))
    body = F.array_join(F.slice("lines", F.col("start") + 1, F.col("end") - F.col("start") + 1), "\n")
    step = step.filter(F.col("end").isNotNull())
    return step.select("doc_id", "text_hash", "start", "end", F.unhex(F.sha2(body, 256)).alias("digest"))


def repeated_pairs(docs):
    """(doc_id, text_hash, start, end) of every later occurrence of a pair of lines.

    Only digests and places are shuffled. The places of a hot pair are joined to one
    row, which leaves the join free to split them.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "start", "end")
    places = materialize(line_pairs(docs).select("digest", place.alias("place")), "pair-places")
    first = places.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = materialize(
        first.filter("first <> last").select(F.col("digest").alias("f_digest"), "first"), "pair-firsts"
    )
    later = places.join(first, F.col("digest") == F.col("f_digest")).filter("place <> first")
    return later.select("place.doc_id", "place.text_hash", "place.start", "place.end")


def dedup_passages(docs):
    """Remove every passage of two lines or more that stands earlier in the corpus, edges included.

    All pairs of neighbouring lines are compared, so no cut has to fall on the edge
    of a passage: a run of lines that repeats is covered by repeated pairs. The first
    place of a pair, by doc_id (NULL last), text hash and position, stays, and so
    does the first place of every line. Lines without a word neither make nor break a
    passage; a repeated line between lines of its own stays.

    Returns doc_id, clean_text, n_lines, n_removed_lines, one row per input row, with
    NULL and empty texts, equal rows and extra columns as in dedup_lines.
    """
    gone = repeated_pairs(docs).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("pairs"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "pairs")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = texts.join(
        gone, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("text_hash") == F.col("g_hash")), "left"
    )
    covered = F.array_distinct(F.flatten(F.transform("pairs", lambda p: F.sequence(p["start"], p["end"]))))
    step = compute_once(
        joined.select("doc_id", "text", "pairs"), lines=F.split(F.coalesce("text", F.lit("")), "\n"), covered=covered
    )
    at = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.array_sort(F.array_except(at, F.coalesce("covered", F.array().cast("array<int>"))))
    step = compute_once(step, kept=F.transform(left, lambda i: F.get("lines", i)))
    return step.select(
        "doc_id",
        F.array_join("kept", "\n").alias("clean_text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("bigint").alias("n_removed_lines"),
    )

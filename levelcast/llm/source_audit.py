"""How far the sources of a language differ: exact divergence of term counts, ranked by count cells.

Terms that a group uses n times and its language m times are one cell: they share
p, q and the divergence f. So f is evaluated once per cell, cells of equal value
are merged, and only cells that reach the top ranks are expanded to terms.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Window, functions as F

from levelcast.llm.common import materialize

# Letters in UTF-8 bytes that are lower-cased already: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
ENTRIES = 300_000  # counts a task holds before it hands them on
COUNTS = "lang string, source string, term binary, n bigint, docs bigint"


def _count_terms(batches):
    """Counts of terms by (lang, source) and how many texts hold each, added up within the task."""
    held = {}

    def rows():
        columns = ([], [], [], [], [])
        for (lang, source), (counts, docs) in held.items():
            columns[0].extend([lang] * len(counts))
            columns[1].extend([source] * len(counts))
            columns[2].extend(counts.keys())
            columns[3].extend(counts.values())
            columns[4].extend(map(docs.__getitem__, counts.keys()))
        held.clear()
        types = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        langs, sources, texts = (batch.column(i) for i in range(3))
        for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            found = TERM.findall(text.as_py().lower())  # on bytes, lower() changes A-Z only
            counts.update(found)
            docs.update(set(found))
        if sum(len(counts) for counts, _ in held.values()) >= ENTRIES:
            yield rows()
    if held:
        yield rows()


def kept_terms(docs, min_docs=MIN_DOCS):
    """(lang, term, total, held): terms in at least `min_docs` rows of a language, with their counts by source.

    `held` has one entry per source that uses the term, in source order.
    """
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(read("lang").alias("lang"), read("source").alias("source"), read("text").cast("binary").alias("text"))
    counts = given.mapInArrow(_count_terms, COUNTS).withColumn("term", F.col("term").cast("string"))
    # Dealt once, by (lang, term): both groupings below find their rows in place.
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("held")
    )
    return by_term.filter(F.col("docs") >= min_docs).drop("docs")


def _p(n, total, terms):
    """1 + floor(10^9 * (n + 2) / (total + 2 * terms)), names of columns; exact beyond 64 bits."""
    return F.expr(f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {SCALE}) DIV CAST({total} + 2 * {terms} AS DECIMAL(20, 0))")


def _f(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) DIV ({p} + {q})")


def groups_of(docs, kept):
    """(lang, source, total, terms) of every occurring group, those without terms included."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(read("lang"), read("source")).distinct()
    used = kept.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    found = groups.join(used, ["lang", "source"], "left").join(terms, "lang", "left")
    return found.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "terms")])


def pair_values(kept, groups):
    """(lang, a, b, value) of every pair of sources a < b: f summed over all kept terms.

    Four kinds of cells: (n, m) of terms that both use; (n, 0) and (0, m), whose
    sizes come from each source's own histogram of counts; and (0, 0). To keep the
    kinds apart, every term first counts as unused by both, a used one adds what
    its use changes for one source, and a shared one what is left.
    """
    sources = groups.withColumn("zero", F.lit(0)).withColumn("p0", F.when(F.col("terms") > 0, _p("zero", "total", "terms")))
    side = lambda s: sources.select("lang", F.col("source").alias(s), F.col("total").alias(f"{s}_total"), F.col("p0").alias(f"{s}_0"))
    pairs = side("a").join(side("b").join(groups.groupBy("lang").agg(F.max("terms").alias("terms")), "lang"), "lang")
    pairs = pairs.filter("a < b")
    base = pairs.select("lang", "a", "b", F.coalesce(F.col("terms") * _f("a_0", "b_0"), F.lit(0)).alias("part"))

    used = kept.select("lang", F.inline("held")).groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    used = used.join(sources, ["lang", "source"]).withColumn("p", _p("n", "total", "terms"))
    one = used.join(side("b"), "lang").filter("source <> b").select(
        "lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"),
        (F.col("m") * (_f("p", "b_0") - _f("p0", "b_0"))).alias("part"),
    )

    held = kept.select("lang", "held", F.posexplode("held").alias("i", "x"))
    both = held.select("lang", "x", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("y"))
    cells = both.groupBy(
        "lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("k")
    ).agg(F.count("*").alias("m"))
    cells = cells.join(pairs, ["lang", "a", "b"]).withColumn("p", _p("n", "a_total", "terms")).withColumn("q", _p("k", "b_total", "terms"))
    change = _f("p", "q") - _f("p", "b_0") - _f("a_0", "q") + _f("a_0", "b_0")
    two = cells.select("lang", "a", "b", (F.col("m") * change).alias("part"))
    return base.unionAll(one).unionAll(two).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def top_terms(kept, groups, top=TOP):
    """(lang, source, item, value, rank): the terms that a source uses most beyond its language, by f."""
    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    rows = kept.select("lang", "term", F.col("total").alias("k"), F.inline("held"))
    cells = rows.groupBy("lang", "source", "n", "k").agg(F.count("*").alias("m"))
    cells = cells.join(groups, ["lang", "source"]).join(whole, "lang")
    cells = cells.withColumn("p", _p("n", "total", "terms")).withColumn("q", _p("k", "lang_total", "terms"))
    cells = cells.filter("p > q").select("lang", "source", "n", "k", "m", _f("p", "q").alias("value"))
    # The `top` highest values hold `top` terms at least; those that begin below rank `top` are left out.
    values = cells.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    falling = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = values.withColumn("nth", F.row_number().over(falling)).filter(F.col("nth") <= top)
    above = F.coalesce(F.sum("m").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = best.withColumn("above", above).filter(F.col("above") < top).groupBy("lang", "source").agg(F.min("value").alias("least"))
    chosen = cells.join(least, ["lang", "source"]).filter(F.col("value") >= F.col("least")).select("lang", "source", "n", "k", "value")
    listed = rows.join(chosen, ["lang", "source", "n", "k"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    ranked = listed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit_sources(docs, min_docs=MIN_DOCS, top=TOP):
    """Divergence between the sources of each language, and the terms that set a source apart.

    Reads text, lang and source; NULL counts as ''. Terms are runs of letters and
    of anything beyond ASCII, with A-Z lower-cased; a language keeps those in at
    least `min_docs` of its rows. With counts smoothed by 2 and scaled to 10^9
    (`_p`), f = floor((p - q)^2 / (p + q)); all arithmetic is on integers.

    Returns lang, source, part, item, value, rank. Part 'pair': every other source
    of the language, f summed over all kept terms (0 without any), all ranks. Part
    'term': terms the source uses more than its language, by f, ranks up to `top`.
    Ranks start at 1 per (lang, source, part): value descending, equal values by
    item in UTF-8 order. Repeated rows count each time they occur; a text without
    terms still makes its group occur; an empty table gives no rows; other columns
    are ignored. A text is read whole by one task. Pairs grow with the square of a
    language's sources, as the result does; nothing is gathered per source.
    """
    kept = materialize(kept_terms(docs, min_docs), "audit-terms")
    groups = materialize(groups_of(docs, kept), "audit-groups")
    values = pair_values(kept, groups)
    mirrored = [values.select("lang", F.col(s).alias("source"), F.col(o).alias("item"), "value") for s, o in ("ab", "ba")]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = mirrored[0].unionAll(mirrored[1]).withColumn("rank", F.row_number().over(order))
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionAll(named(top_terms(kept, groups, top), "term"))

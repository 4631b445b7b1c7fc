"""Near duplicates from bottom-k sketches of one hash function.

How a link is found, without ever pairing up all members of a group:

1. Equal shingle sets form a class; only classes go on.
2. A sketch is the k smallest shingle hashes of a set. Two sets as similar as
   asked share at least t sketch values (a binomial bound: fewer with a chance of
   1e-9; for sets that fit into the sketch the bound is exact). A value that one
   class alone holds cannot be shared, so a class with fewer than t other values
   has no partner. A short sketch rules out most classes in this way, a long one
   is taken of the rest.
3. Values are ordered by how many classes hold them, rarest first; if two sketches
   share t values, they share one among the first k - t + 1 of each. Only these
   enter the inverted lists, so a passage that thousands of documents quote builds
   no list unless the documents are made of it.
4. Every class of a list is first paired with the list's leaders: those with the
   fewest values of their own, which copies of a text lie around. Only lists whose
   members are then still in different components pair those members, and only in
   the first list that two of them share. No pair is made that sizes, counts of
   shareable values or the place of the value in both orders rule out: for sets
   inside the long sketch these bounds are exact.
5. A pair is estimated from the union of the two sketches and confirmed on the
   full sets.
"""

import math

from pyspark.sql import Window, functions as F

from levelcast.llm.common import lower_ascii, materialize, words_of
from levelcast.operators.stages import compute_once

SKETCH = 48
LONG_SKETCH = 512
LEADERS = 3
LOOK_BACK = 8  # earlier values that tell whether two members have met already
MISS = 1e-9  # chance that a true link shares fewer than t sketch values


def least_shared(k, percent, miss=MISS):
    """The largest t such that binomial(k, percent / 100) is below t with a chance of `miss` at most."""
    p, below, t = percent / 100.0, 0.0, 0
    while t < k:
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def shingle_sets(docs, width):
    """doc_id, text_hash and the sorted hashes of the distinct shingles of every row."""
    step = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(lower_ascii(F.col("text"))).alias("words"))
    step = compute_once(step, keep=["doc_id", "text_hash"], words=F.col("words"))
    n = F.size("words")
    shingle = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)])
    hashes = F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), shingle))
    hashes = hashes.when(n > 0, F.array(F.xxhash64("words"))).otherwise(F.array().cast("array<bigint>"))
    return compute_once(step, keep=["doc_id", "text_hash"], shingles=F.sort_array(F.array_distinct(hashes)))


def _class_id(shingles):
    """128 bits that name a set of shingles."""
    part = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), shingles)), 16, "0")
    return F.unhex(F.concat(part(1), part(2)))


def _needed(k, percent):
    """Sketch values a set of n shingles must share with any partner."""
    exact = F.floor((F.col("n") * percent + 99) / 100).cast("int")
    return F.when(F.col("n") * 100 <= k * percent, exact).otherwise(F.lit(least_shared(k, percent)))


def _close_sizes(a, b, percent):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shared_values(classes, k, percent, name):
    """(c, n, shared): sketch values that other classes hold too, rarest first.

    Classes that have too few of them for any partner are left out.
    """
    values = classes.select("c", "n", F.explode("sketch").alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    counts = materialize(counts.withColumnRenamed("value", "v"), f"{name}-values")
    held = values.join(counts, F.col("value") == F.col("v"))
    per = held.groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"))
    per = per.filter(F.size("shared") >= _needed(k, percent))
    return per.withColumn("shared", F.transform("shared", lambda s: s["value"]))


def inverted_lists(shared, k, percent):
    """(value, c, n, s, i): the values by which a partner must be found.

    s counts the shareable values of a class, i is the place of the value in its
    order; values of one class only are the rarest and take the first places.
    """
    length, s = F.least(F.col("n"), F.lit(k)), F.size("shared")
    lone = length - s
    places = length - _needed(k, percent) + 1 - lone
    prefix = F.slice("shared", F.lit(1), F.greatest(places, F.lit(0)).cast("int"))
    lists = shared.select("c", "n", s.alias("s"), lone.alias("lone"), F.posexplode(prefix).alias("at", "value"))
    return lists.select("value", "c", "n", "s", (F.col("lone") + F.col("at")).cast("bigint").alias("i"))


def _possible(a, b, k, percent):
    """Whether two entries of one list leave room for the similarity, this being their first common value.

    Two sets of n and m shingles need common = percent * (n + m) / (100 + percent)
    shingles; what stands before the value, and what no other class holds, is lost.
    """
    needs = (a["n"] + b["n"]) * percent
    room = lambda x: F.least(x["s"].cast("bigint"), x["n"] - x["i"]) * (100 + percent) >= needs
    whole = (a["n"] <= k) & (b["n"] <= k)
    most = F.least(a["s"], b["s"])
    return _close_sizes(a["n"], b["n"], percent) & F.when(whole, room(a) & room(b)).otherwise(
        most >= least_shared(k, percent)
    )


def _keep_likely(pairs, sketches, k, percent):
    """Pairs whose estimate from the union of both sketches does not rule them out."""
    of = lambda side: sketches.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    common = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    # All hashes of both sets are in the sketches when the sets are small: then the estimate is exact.
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    all_common = F.size(F.array_intersect("s_a", "s_b"))
    exact = all_common * 100 >= (F.col("n_a") + F.col("n_b") - all_common) * percent
    likely = F.when(whole, exact).otherwise(common >= least_shared(k, percent))
    return both.filter(_close_sizes(F.col("n_a"), F.col("n_b"), percent)).filter(likely).select("a", "b")


def _confirm(pairs, sets, percent):
    of = lambda side: sets.select(F.col("c").alias(side), F.col("shingles").alias(f"s_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.filter(common * 100 >= union * percent).select("a", "b")


def components(links, name="near-labels"):
    """(c, label): the smallest id reachable over links (a, b); ids without links are left out.

    Every round takes the least label among neighbours, then follows the label's
    own label, so chains shorten fast. Rounds are written tables; only the number
    of changed labels reaches the driver.
    """
    both = materialize(
        links.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .unionAll(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
        .distinct(),
        "near-links",
    )
    labels = materialize(both.groupBy("x").agg(F.min("y").alias("y")).select(
        F.col("x").alias("c"), F.least("x", "y").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("c", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("c") == F.col("x"), "left").select(
            "c", F.least("label", F.coalesce("near", "label")).alias("next"), "label"
        )
        stepped = materialize(stepped, name)
        hop = stepped.select(F.col("c").alias("next"), F.col("next").alias("far"))
        new = materialize(stepped.join(hop, "next").select("c", F.least("far", "next").alias("label"), F.col("label").alias("old")), name)
        changed = new.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = new.select("c", "label")
        if not changed:
            return labels


def mixed_pairs(left, k, percent):
    """(a, b): members of different components that share a list, at the first list that both are in.

    `left` has the entries of the lists and `before`, the values of the class that
    stand just before. A pair may come again where a longer stretch parts two
    values that both members hold.
    """
    x, y = left.alias("x"), left.alias("y")
    fields = ("n", "s", "i")
    met_first = ~F.arrays_overlap("x.before", "y.before")
    return x.join(
        y,
        (F.col("x.value") == F.col("y.value"))
        & (F.col("x.c") < F.col("y.c"))
        & (F.col("x.label") != F.col("y.label"))
        & met_first
        & _possible(*[{f: F.col(f"{side}.{f}") for f in fields} for side in "xy"], k, percent),
    ).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))


def links_between(classes, rep_sets, k=SKETCH, long_k=LONG_SKETCH, percent=85, leaders=LEADERS):
    """Links (a, b) that connect the same classes as all links of `percent` or more do.

    `classes` has (c, n, sketch); `rep_sets(survivors)` gives (c, shingles) for
    the classes that can have a partner. Links are between ids of the survivors,
    returned as (id, c) as well.
    """
    first = shared_values(classes, k, percent, "near-short").select("c")
    # Written, so the ids stay as they are.
    survivors = materialize(
        rep_sets(first).withColumn("id", F.monotonically_increasing_id()), "near-sets"
    )
    sets = survivors.select(F.col("id").alias("c"), F.size("shingles").cast("bigint").alias("n"), "shingles")
    long = sets.select("c", "n", F.slice("shingles", 1, long_k).alias("sketch"))
    sketches = sets.select("c", "n", F.slice("shingles", 1, k).alias("sketch"))
    lists = materialize(
        inverted_lists(shared_values(long, long_k, percent, "near-long"), long_k, percent), "near-lists"
    )

    fields = ("c", "n", "s", "i")
    order = [(F.col("n") - F.col("s")) / F.col("n")] + [F.xxhash64(F.lit(i), "c") for i in range(1, leaders)]
    firsts = lists.groupBy("value").agg(
        *[F.min(F.struct(o.alias("o"), *fields)).alias(f"l{i}") for i, o in enumerate(order)],
        F.count("*").alias("m"),
    )
    firsts = materialize(
        firsts.filter("m > 1").select(F.col("value").alias("v"), *[f"l{i}" for i in range(leaders)]), "near-leaders"
    )
    # A class meets mostly the same leaders in its lists: gathered per class before pairs are made.
    own = {x: F.col(x) for x in fields}
    met = lambda l: F.when((l["c"] != own["c"]) & _possible(own, l, long_k, percent), l["c"])
    led = lists.join(firsts, F.col("value") == F.col("v")).groupBy("c").agg(
        F.array_distinct(F.flatten(F.array(*[F.collect_set(met(F.col(f"l{i}"))) for i in range(leaders)]))).alias("ls")
    )
    starred = led.select("c", F.explode("ls").alias("l"))
    pairs = starred.select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b"))
    pairs = materialize(pairs.distinct(), "near-pairs")
    star_links = materialize(_confirm(_keep_likely(pairs, sketches, k, percent), sets, percent), "near-star-links")
    labels = components(star_links)

    # Lists whose members are in more than one component still may hide links.
    placed = lists.join(labels.withColumnRenamed("c", "lc"), F.col("c") == F.col("lc"), "left").select(
        "value", *fields, F.coalesce("label", "c").alias("label")
    )
    placed = materialize(placed, "near-placed")
    mixed = placed.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"))
    mixed = materialize(mixed.filter("lo <> hi AND m > 2").select(F.col("value").alias("v")), "near-mixed")
    left = placed.join(mixed, F.col("value") == F.col("v"), "left_semi")
    # Two members meet in every list they share, but are paired at the first: where the values
    # just before have one in common, an earlier list has both of them.
    before = Window.partitionBy("c").orderBy("i").rowsBetween(-LOOK_BACK, -1)
    left = materialize(left.withColumn("before", F.collect_list("value").over(before)), "near-left")
    others = mixed_pairs(left, long_k, percent)
    others = materialize(others.distinct().join(pairs, ["a", "b"], "left_anti"), "near-others")
    more = _confirm(_keep_likely(others, sketches, k, percent), sets, percent)
    links = materialize(star_links.unionAll(more), "near-all-links")
    return links, survivors.select("id", "c")


def near_duplicates(docs, width=5, percent=80, k=SKETCH, long_k=LONG_SKETCH, leaders=LEADERS):
    """Group documents that are linked, directly or through others, by near-equal texts.

    A text's set: distinct shingles of `width` words (A-Z lower-cased); with fewer
    words, the whole sequence as one shingle; without words, empty and linked with
    nothing. Two documents are linked when 100 * common >= percent * union.

    Returns doc_id, text_hash, n_shingles, component_id (smallest doc_id of the
    group), kept (doc_id = component_id) and representative (the row of that id
    with the smallest text hash), one row per input row. NULL texts have an empty
    set. Repeated rows are in one group and answer alike. NULL doc_ids take part
    in links; a group of NULL ids only has a NULL component_id and its rows are
    kept. An empty table gives an empty result; extra columns are ignored.
    """
    made = shingle_sets(docs, width)
    rows = materialize(
        made.select(
            "doc_id", "text_hash", F.size("shingles").cast("bigint").alias("n"),
            _class_id(F.col("shingles")).alias("c"), F.slice("shingles", 1, k).alias("sketch"),
        ),
        "near-rows",
    )
    filled = rows.filter("n > 0")
    # NULL ids last, so that a group is named by a real id where it has one.
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    classes = filled.groupBy("c").agg(F.min(member).alias("rep"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(classes, "near-classes")

    def rep_sets(survivors):
        reps = classes.join(survivors, "c", "left_semi").select(F.col("rep.doc_id").alias("r_id"), F.col("rep.text_hash").alias("r_hash"), "c")
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
        chosen = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")))
        chosen = chosen.dropDuplicates(["c"]).select(F.col("c").alias("doc_id"), "text")
        return shingle_sets(chosen, width).select(F.col("doc_id").alias("c"), "shingles")

    links, ids = links_between(classes.select("c", "n", "sketch"), rep_sets, k, long_k, percent, leaders)
    labels = components(links).select(F.col("c").alias("id"), "label").join(ids, "id").select("c", "label")
    named = classes.select("c", "rep").join(labels, "c", "left").select(
        "c", F.coalesce(F.hex(F.col("label")), F.hex("c")).alias("label"), "rep"
    )
    named = materialize(named, "near-named")
    lowest = materialize(named.groupBy("label").agg(F.min("rep").alias("lead")), "near-lowest")
    per_class = materialize(named.join(lowest, "label").select("c", "lead"), "near-components")
    found = rows.filter("n > 0").join(per_class, "c").unionByName(
        rows.filter("n = 0").withColumn("lead", member)
    )
    is_named = F.col("doc_id").eqNullSafe(F.col("lead.doc_id"))
    return found.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("lead.doc_id").alias("component_id"),
        is_named.alias("kept"), (is_named & (F.col("text_hash") == F.col("lead.text_hash"))).alias("representative"),
    )

"""Spelling variants: words one edit apart, found in sorted lists with shared edit-matrix rows.

How near words meet, without pairing up the vocabulary:

1. Two words one edit apart, the shorter of m code points, agree before and after
   the edit. The places 0..m are cut into two windows; the edit lies in one, and
   what is outside it is equal. So words meet in a list per (m, window, text before,
   text after). A list that is too long is dealt into two lists of half the window.
   At a window of one place the alphabet bounds a list.
2. Within a list the middles (the texts inside the window) are sorted. A range of
   middles with a common prefix shares one row of the edit matrix against each
   middle, a band of three cells; adjacent common-prefix lengths tell where ranges
   begin and end. A range whose row has no cell up to 1 is skipped whole.
   Rows of all ranges of one prefix length are computed together.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from levelcast.llm.common import materialize

MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97
LIST_LIMIT = 4096
ENTRIES = 400_000  # counts a task holds before it hands them on
CHUNK = 16_384  # middles whose rows are computed together
NEAR = "word string, n bigint, other string, other_n bigint"


def damaged(run, doc_crc, every=DAMAGE):
    """The run, without one code point where `every` divides the crc32 of `<doc_id>:<run>`."""
    h = zlib.crc32(run.encode(), doc_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count_words(min_length, every):
    # Runs are whole: a match cannot begin or end inside a longer run.
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def count(batches):
        held = Counter()
        rows = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                crc = zlib.crc32(f"{doc_id}:".encode())
                # On bytes, lower() changes A-Z only.
                for run, n in Counter(runs.findall(text.as_py().lower().decode())).items():
                    word = damaged(run, crc, every)
                    if len(word) >= min_length:
                        held[word] += n
            if len(held) >= ENTRIES:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return count


def vocabulary(docs, min_length=MIN_LENGTH, min_count=MIN_COUNT, every=DAMAGE):
    """(word, n): words of enough code points and occurrences."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(read("doc_id").alias("doc_id"), read("text").cast("binary").alias("text"))
    counts = given.mapInArrow(_count_words(min_length, every), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


KEY = ["m", "s", "e", "before", "after"]


def _windowed(rows, s, e):
    """Members of the lists of window [s, e): what stands before and after it, and the middle.

    `rows` has word, n and m; of the two words of a pair the longer has m + 1 code points.
    """
    length = F.length("word")
    tail = F.col("m") - e
    return rows.select(
        "m", s.alias("s"), e.alias("e"),
        F.substr("word", F.lit(1), s).alias("before"),
        F.substr("word", length - tail + 1, tail).alias("after"),
        F.substr("word", s + 1, length - tail - s).alias("middle"), "word", "n",
    )


def _halves(rows, s, e):
    at = F.floor((s + e) / 2).cast("int")
    first, second = _windowed(rows, s, at), _windowed(rows, at, e)
    return first.unionAll(second)


def _prefix_rows(chars, offsets, lengths, common):
    """Pairs (i, j), i < j, of middles with an edit distance of 1 inside the same list.

    Middles are sorted within lists; `common[i]` is the length of the prefix that
    middle i shares with the one before it, -1 at the start of a list. Goes down
    the prefix lengths; `node` and `query` are the ranges and middles whose row,
    cells (x, y, z) around the diagonal, still has a cell up to 1.
    """
    total = len(lengths)
    char = lambda i, k: np.where((k >= 0) & (k < lengths[i]), chars[np.clip(offsets[i] + k, 0, max(len(chars) - 1, 0))], -1)
    starts = np.flatnonzero(common < 0)
    ends = np.append(starts[1:], total)
    query = np.arange(total)
    node = np.repeat(np.arange(len(starts)), ends - starts)
    x, y, z = np.full(total, 2, np.int8), np.zeros(total, np.int8), np.where(lengths >= 1, 1, 2).astype(np.int8)
    found, depth = [], 0
    while len(query):
        # A middle as long as the prefix is the first of its range: its distance is the cell at the query's end.
        first = starts[node]
        over = lengths[query] - depth
        cell = np.select([over == -1, over == 0, over == 1], [x, y, z], 2)
        hit = (lengths[first] == depth) & (cell == 1) & (first != query)
        found.append(np.stack([first[hit], query[hit]]))
        # Ranges one code point longer, and the rows of those that a live range holds.
        below = np.flatnonzero(common < depth + 1)
        bounds = np.append(below[1:], total)
        low, high = np.searchsorted(below, starts), np.searchsorted(below, ends)
        children = high - low
        size = children[node]
        parent = np.repeat(np.arange(len(query)), size)
        child = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[node], size)
        head = below[child]
        alive = lengths[head] > depth
        parent, child, head = parent[alive], child[alive], head[alive]
        query = query[parent]
        c = char(head, np.full(len(head), depth))
        off = lambda k: (c != char(query, np.full(len(query), k))).astype(np.int8)
        room = lengths[query] - depth
        px, py, pz = x[parent], y[parent], z[parent]
        x = np.minimum(py + 1, px + off(depth - 1))
        x = np.where(room >= 0, x, 2)
        y = np.where(room >= 1, np.minimum(np.minimum(pz + 1, py + off(depth)), x + 1), 2)
        z = np.where(room >= 2, np.minimum(pz + off(depth + 1), y + 1), 2)
        near = np.minimum(np.minimum(x, y), z) <= 1
        query, node = query[near], child[near]
        x, y, z = (np.minimum(v[near], 2).astype(np.int8) for v in (x, y, z))
        starts, ends, depth = below, bounds, depth + 1
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    return pairs[:, pairs[0] < pairs[1]]


def _shared(a, b):
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    return next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)


def _pairs_of(lists):
    """Near words of some lists, (m, s, e, before, after, members as (middle, n)), both ways round."""
    middles, counts, common, where = [], [], [], []
    for number, (*_, members) in enumerate(lists):
        members = sorted(members)
        for k, (middle, n) in enumerate(members):
            common.append(_shared(members[k - 1][0], middle) if k else -1)
            middles.append(middle)
            counts.append(n)
            where.append(number)
    lengths = np.array([len(x) for x in middles], dtype=np.int64)
    chars = np.frombuffer("".join(middles).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    offsets = np.cumsum(lengths) - lengths
    for i, j in _prefix_rows(chars, offsets, lengths, np.array(common)).T.tolist():
        m, s, e, before, after, _ = lists[where[i]]
        a, b = middles[i], middles[j]
        if len(a) == len(b):
            if len(a) != e - s:
                continue  # both have m + 1 code points: they meet in a list of that m
        elif e < m and max(a, b, key=len).startswith(min(a, b, key=len)):
            continue  # the added code point stands at the end: they meet in the next window
        a, b = before + a + after, before + b + after
        yield a, counts[i], b, counts[j]
        yield b, counts[j], a, counts[i]


def _near_words(batches):
    def rows(lists):
        columns = list(zip(*_pairs_of(lists))) or [(), (), (), ()]
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n", "other", "other_n"])

    for batch in batches:
        held, size = [], 0
        fields = [batch.column(i) for i in range(len(KEY) + 2)]
        for k in range(batch.num_rows):
            *key, middles, counts = (f[k].as_py() for f in fields)
            held.append((*key, list(zip(middles, counts))))
            size += len(middles)
            if size >= CHUNK:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)


def near_words(words, min_length=MIN_LENGTH, limit=LIST_LIMIT):
    """(word, n, other, other_n): every pair of words one edit apart, both ways round, once each."""
    ms = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(ms).alias("m")).filter(F.col("m") >= max(min_length, 1))
    members, found = _halves(rows, F.lit(0), F.col("m")), []
    while True:
        sizes = members.groupBy(*KEY).agg(F.count("*").alias("size")).filter((F.col("size") > limit) & (F.col("e") - F.col("s") > 1))
        long = materialize(sizes.select(*KEY), "spelling-long")
        short = members.join(long, KEY, "left_anti").groupBy(*KEY).agg(F.collect_list("middle").alias("middles"), F.collect_list("n").alias("ns"))
        found.append(short.filter(F.size("middles") > 1).mapInArrow(_near_words, NEAR))
        if long.isEmpty():
            break
        rest = materialize(members.join(long, KEY, "left_semi").select("word", "n", "m", "s", "e"), "spelling-rest")
        members = _halves(rest, F.col("s"), F.col("e"))
    near = found[0]
    for more in found[1:]:
        near = near.unionAll(more)
    return near


def roots_of(forms):
    """(word, root): the end of each word's chain of forms; `forms` has (word, form), none of them NULL.

    Counts at least double along a chain, so it has no circle and at most 63
    steps; each round doubles the steps taken.
    """
    roots = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(roots.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), "far"), "spelling-roots")
        roots = step.select("word", "root")
        if step.filter("far IS NOT NULL").isEmpty():
            return roots


def spelling_variants(docs, min_length=MIN_LENGTH, min_count=MIN_COUNT, every=DAMAGE, limit=LIST_LIMIT):
    """Words of the texts, each with the much more frequent word it is a variant of.

    Words are runs of letters (A-Z lower-cased), a fixed share of them damaged as
    `damaged` says; they need `min_length` code points and `min_count` occurrences
    in all. Near words differ by one inserted, deleted or replaced code point. A
    word's form is its near word of the largest n (equal n: first in code-point
    order) if that n is at least twice its own; root follows forms to the last.

    Returns word, form, root, n, n_near, form_n, one row per word; form and form_n
    are NULL without a form, root is then the word. NULL texts and texts without
    runs add nothing, a NULL id reads as ''; repeated rows count each time; an empty
    table gives no rows; other columns are ignored. A text is read whole by one
    task; a word may be of any length. No list passed to a task holds more than
    `limit` words, or what the alphabet allows in one place.
    """
    words = materialize(vocabulary(docs, min_length, min_count, every), "spelling-words")
    near = near_words(words, min_length, limit).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    has = -F.col("best.less") >= 2 * F.col("n")
    forms = near.select("word", "n_near", F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    forms = materialize(forms, "spelling-forms")
    roots = roots_of(forms.filter("form IS NOT NULL").select("word", "form"))
    named = words.join(forms, "word", "left").join(roots, "word", "left")
    return named.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )

"""Benchmark decontamination by pigeonhole edit matching."""

import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import functions as F

ERROR_RATE = 0.08
MIN_CHARS = 40  # shorter items must occur without an error, between word ends
BLOCK_CHARS = 4_000_000  # characters of items that are broadcast at a time


def normalise(text):
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def budget(length, rate=ERROR_RATE):
    return int(length * rate) if length >= MIN_CHARS else 0


def in_word(c):
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def parted(text, at):
    """No word goes on across this place: an end of the text, or a non-word character on either side."""
    return at in (0, len(text)) or not (in_word(text[at - 1]) and in_word(text[at]))


def split_pieces(item, errors):
    """(offset, piece) of errors + 1 pieces of nearly equal length: one survives `errors` edits."""
    n, parts = len(item), errors + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern_bits, length, text, limit):
    """Least edit distance of the pattern to any substring, and where that ends; None above `limit`.

    Myers' bit-parallel columns in one arbitrary-precision integer.
    """
    mask, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = mask, 0, length
    best, at, n = limit + 1, -1, len(text)
    for i, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & mask)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        plus = ((mh << 1) | ~(xv | ph)) & mask
        minus = ph & xv
        if score < best:
            best, at = score, i + 1
            if not best:
                break
        elif score - (n - i - 1) >= best:
            break  # not enough text left to get below the best
    return (best, at) if best <= limit else None


def bits_of(pattern):
    bits = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | (1 << i)
    return bits


class Matcher:
    """Finds the items of one block in a text."""

    def __init__(self, items, rate):
        self.items = []
        self.machine = ahocorasick.Automaton()
        pieces = {}
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            errors = budget(len(text), rate)
            self.items.append((item_id, text, errors, bits_of(text)))
            for offset, piece in split_pieces(text, errors):
                pieces.setdefault(piece, []).append((len(self.items) - 1, offset))
        for piece, where in pieces.items():
            self.machine.add_word(piece, (len(piece), where))
        if pieces:
            self.machine.make_automaton()
        self.empty = not pieces

    def windows(self, text):
        """Per item, the joined stretches of text that its piece hits allow it to lie in."""
        found = {}
        for end, (length, where) in self.machine.iter(text):
            for item, offset in where:
                found.setdefault(item, set()).add(end + 1 - length - offset)
        for item, starts in found.items():
            _, pattern, errors, _ = self.items[item]
            spans, last = [], None
            for start in sorted(starts):
                lo, hi = max(start - errors, 0), min(start + len(pattern) + errors, len(text))
                if last is not None and lo <= last[1]:
                    last[1] = max(last[1], hi)
                else:
                    last = [lo, hi]
                    spans.append(last)
            yield item, spans

    def find(self, text):
        """(item_id, distance, start, end) of the best match of every item found, in normalised text."""
        if self.empty:
            return []
        text, hits = normalise(text), []
        for item, spans in self.windows(text):
            item_id, pattern, errors, bits = self.items[item]
            best = None
            for lo, hi in spans:
                part = text[lo:hi]
                if not errors:
                    best = best or self.exact(text, pattern, lo, hi)
                elif (m := best_match(bits, len(pattern), part, errors)) and (best is None or m[0] < best[0]):
                    back = best_match(bits_of(pattern[::-1]), len(pattern), part[: m[1]][::-1], m[0])
                    best = (m[0], lo + m[1] - (back[1] if back else len(pattern)), lo + m[1])
                if best and not best[0]:
                    break
            if best:
                hits.append((item_id, *best))
        return hits

    @staticmethod
    def exact(text, pattern, lo, hi):
        at = text.find(pattern, lo, hi)
        while at >= 0:
            end = at + len(pattern)
            if parted(text, at) and parted(text, end):
                return 0, at, end
            at = text.find(pattern, at + 1, hi)
        return None


def item_blocks(benchmark, block_chars=BLOCK_CHARS):
    """The items, in as many blocks as it takes to keep each near `block_chars` characters.

    A small test set is one block. A larger one is searched block by block, each
    against all rows, so what is broadcast never grows with the test set.
    """
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = math.ceil(total / block_chars) or 1
    block = F.pmod(F.xxhash64("text"), F.lit(n))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.filter(block == k)
        rows = part.select("item_id", "text").filter(F.col("text").isNotNull()).dropDuplicates().collect()
        yield sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[1], str(x[0])))


def _finder(shared, rate, returns):
    names = ("item_id", "distance", "match_start", "match_end")

    @F.pandas_udf(returns)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for batch in texts:
            yield pd.Series([[dict(zip(names, hit)) for hit in matcher.find(t)] for t in batch], dtype=object)

    return found


def matches_of(docs, benchmark, rate, block_chars):
    """An array column of matches for each block of items."""
    kind = benchmark.schema["item_id"].dataType.simpleString()
    returns = f"array<struct<item_id:{kind},distance:int,match_start:int,match_end:int>>"
    for items in item_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        yield _finder(shared, rate, returns)(F.coalesce("text", F.lit("")))


def contamination(docs, benchmark, rate=ERROR_RATE, block_chars=BLOCK_CHARS):
    """Which documents hold a benchmark item, up to an edit distance of `rate` of its length.

    An item is cut into one piece more than it may have errors, so one piece is
    unharmed in any copy. An Aho-Corasick pass over the whole text finds the
    pieces; Myers' distance decides on the stretches around them. Case and the
    kind of white space do not count. Items under 40 characters must occur without
    an error, as whole words, whatever punctuation touches them; NULL and blank items are never found.

    Returns doc_id, item_id, distance, match_start, match_end (in the normalised
    text), one row per document row and item found. NULL and empty texts match
    nothing, repeated rows are reported repeatedly, a NULL doc_id is carried
    through, items of equal text are all reported. Extra columns are ignored.
    Documents are mapped in place: nothing is shuffled.
    """
    parts = [
        docs.select("doc_id", F.explode(hits).alias("hit")).select("doc_id", "hit.*")
        for hits in matches_of(docs, benchmark, rate, block_chars)
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def decontaminate(docs, benchmark, rate=ERROR_RATE, block_chars=BLOCK_CHARS):
    """The rows of `docs` that hold no benchmark item; columns stay as they are."""
    for hits in matches_of(docs, benchmark, rate, block_chars):
        docs = docs.withColumn("__hits", F.size(hits)).filter(F.col("__hits") == 0).drop("__hits")
    return docs

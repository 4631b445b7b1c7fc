"""Toxicity by the nearest labelled texts: exact TF-IDF cosine over all terms of a bounded sample."""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from levelcast.llm.samples import class_weights, fit_logistic, labelled_sample, logistic

TOKEN = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)  # word beginnings that count as terms besides the word
MIN_DF = 4
MIN_CHI2 = 30.0
FULL_CHI2 = 120.0  # chi-square from which a term has the whole boost
BOOST = 20.0  # most that label strength can multiply the weight of a term by
NEIGHBOURS = 15
BLOCK = 16  # texts of a block
LONG = 8  # lists of more than 1 / LONG of the texts are kept in blocks
MEMORY = 2_000_000  # characters of texts that are taken apart at once
HYPHEN = pa.scalar("", pa.large_string()), pa.scalar("-", pa.large_string())  # nothing, joined by a hyphen
PER_CLASS = 2500
MAX_BYTES = 24_000_000


def terms(text):
    """Counts of words and of word beginnings."""
    counts = Counter(TOKEN.findall(text.lower()))
    beginnings = {}
    for word, n in counts.items():
        size = len(word)
        for k in STEMS:
            if size <= k:
                break
            term = word[:k] + "-"
            beginnings[term] = beginnings.get(term, 0) + n
    counts.update(beginnings)  # no word holds a hyphen
    return counts


def strengths(bags, ys, weights):
    """Factor of every term: above 1 where its presence goes with the label, by chi-square over weighted documents.

    No term is left out. Terms of less than MIN_CHI2 or MIN_DF have the factor 1.
    """
    numbers, rows = {}, []
    for bag in bags:
        rows.append(np.array([numbers.setdefault(term, len(numbers)) for term in bag], dtype=np.int32))
    if not numbers:
        return {}
    ys, weights = np.asarray(ys, float), np.asarray(weights, float)
    sizes, at = [len(r) for r in rows], np.concatenate(rows)
    n = np.bincount(at, np.repeat(weights, sizes), len(numbers))
    a = np.bincount(at, np.repeat(weights * ys, sizes), len(numbers))
    total, total_toxic = weights.sum(), (weights * ys).sum()
    expected = n * total_toxic / total
    chi2 = (a - expected) ** 2 / (expected * (1 - total_toxic / total) * (1 - n / total) + 1e-9)
    strong = (np.bincount(at, minlength=len(numbers)) >= MIN_DF) & (chi2 >= MIN_CHI2)
    factors = np.where(strong, 1.0 + (BOOST - 1.0) * np.minimum(1.0, np.sqrt(chi2 / FULL_CHI2)), 1.0)
    return dict(zip(numbers, factors.tolist()))


class TermReader:
    """Numbers and counts of texts' terms, found and counted in arrays for many texts at once.

    `vocabulary` holds the terms in the order of their numbers. Terms outside it have
    numbers from its size on, good for texts taken apart together: as many as have
    `memory` characters.
    """

    def __init__(self, vocabulary, memory=MEMORY):
        self.vocabulary, self.memory = pa.array(list(vocabulary), pa.large_string()), memory
        self.common = bytes(c < 0x80 and bool(TOKEN.match(chr(c))) for c in range(256))

    def in_words(self, data):
        """Which bytes of a text in UTF-8 are of characters that TOKEN takes."""
        inside = np.frombuffer(data.tobytes().translate(self.common), dtype=bool).copy()
        far = data >= 0x80
        if far.any():
            points = np.frombuffer(data[far].tobytes().decode().encode("utf-32-le"), np.uint32)
            distinct, places = np.unique(points, return_inverse=True)
            taken = np.array([bool(TOKEN.match(chr(c))) for c in distinct.tolist()])[places]
            inside[far] = np.repeat(taken, 2 + (points >= 0x800).astype(np.int8) + (points >= 0x10000))
        return inside

    def words_of(self, texts):
        """By distinct (text, word): the text's number, the word's number, how often; also the distinct words."""
        lowered = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\0".join([*lowered, b""]), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1) - 1
        inside = self.in_words(data)
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        starts, sizes = edges[::2], np.diff(edges)[::2]
        bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        letters = pa.py_buffer(data[inside])
        found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds, letters]).dictionary_encode()
        words = found.dictionary
        keys = np.searchsorted(ends, starts) * max(len(words), 1) + found.indices.to_numpy()
        keys.sort()
        firsts = np.flatnonzero(np.diff(keys, prepend=-1))
        return *np.divmod(keys[firsts], max(len(words), 1)), np.diff(np.append(firsts, len(keys))), words

    def terms_of(self, words):
        """By word and term: the word's number, the term's number; also the bound of the latter."""
        sizes, terms, owners = pc.utf8_length(words).to_numpy(), [words], [np.arange(len(words))]
        for k in STEMS:
            owners.append(np.flatnonzero(sizes > k))
            stems = pc.utf8_slice_codeunits(words.take(pa.array(owners[-1])), 0, k)
            terms.append(pc.binary_join_element_wise(stems, *HYPHEN))
        found = pa.concat_arrays(terms).dictionary_encode()
        # The vocabulary is looked up in the terms: they are fewer, and only they are hashed again for every batch.
        places = pc.index_in(self.vocabulary, value_set=found.dictionary).fill_null(-1).to_numpy()
        known = np.flatnonzero(places >= 0)
        numbers = np.full(len(found.dictionary), -1, dtype=np.int64)
        numbers[places[known]] = known
        others = np.flatnonzero(numbers < 0)
        numbers[others] = len(self.vocabulary) + np.arange(len(others))
        return np.concatenate(owners), numbers[found.indices.to_numpy()], len(self.vocabulary) + len(others)

    def read_some(self, texts):
        """(numbers, counts) of the terms of every text, in ascending order of the numbers."""
        of_text, of_word, times, words = self.words_of(texts)
        owners, numbers, span = self.terms_of(words)
        order = np.argsort(owners, kind="stable")
        numbers, sizes = numbers[order], np.bincount(owners, minlength=len(words))
        spread = sizes[of_word]
        before = np.cumsum(spread) - spread
        at = np.arange(int(spread.sum())) + np.repeat((np.cumsum(sizes) - sizes)[of_word] - before, spread)
        # Sorted as one number each: text, term, count.
        bits = int(times.max(initial=1)).bit_length()
        keys = np.repeat(of_text, spread) * span + numbers[at]
        keys = keys << bits | np.repeat(times, spread)
        keys.sort()
        terms_at = keys >> bits
        firsts = np.flatnonzero(np.diff(terms_at, prepend=-1))
        counts = np.add.reduceat(keys & (1 << bits) - 1, firsts) if len(firsts) else firsts
        terms_at = terms_at[firsts]
        cuts = np.searchsorted(terms_at, np.arange(1, len(texts)) * span)
        return zip(np.split(terms_at % max(span, 1), cuts), np.split(counts.astype(float), cuts))

    def read_all(self, texts):
        """(numbers, counts) of the terms of every text, one after the other."""
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > self.memory:
                yield from self.read_some(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self.read_some(some)

    def read(self, text):
        return next(self.read_all([text]))


def similar_order(at, held, weights, n, size, directions=24):
    """Order of texts in which similar ones stand together: halved by the main direction of random projections."""
    rng, seen = np.random.default_rng(7), np.zeros((n, directions))
    terms_seen = int(at.max()) + 1 if len(at) else 0
    for k in range(directions):
        seen[:, k] = np.bincount(held, weights * rng.standard_normal(terms_seen)[at], n)
    done, parts = [], [np.arange(n)]
    while parts:
        part = parts.pop()
        if len(part) <= size:
            done.append(part)
            continue
        middle = seen[part] - seen[part].mean(0)
        main = np.linalg.svd(middle, full_matrices=False)[2][0]
        part = part[np.argsort(middle @ main, kind="stable")]
        half = -(-len(part) // (2 * size)) * size  # whole blocks on the left
        parts += [part[half:], part[:half]]
    return np.concatenate(done or [np.zeros(0, np.int64)])


class BlockMaxIndex:
    """Inverted lists of all terms of the sampled texts, the long ones in blocks with their maxima.

    Similar texts share a block of BLOCK texts. A list is long when it holds more than
    n / LONG texts; it keeps its weights block by block and the largest one of each
    block. A query adds up its short lists. What the long ones can add to a text is
    bounded by the maxima of its block and by the length of its part in them. Texts
    are taken from the highest bound on; those that cannot reach the k-th best stay
    closed. The result is the exact top k. Terms that no sampled text has count in the
    length of a query.
    """

    def __init__(self, vocabulary, bags, ids, ys, factors=None, block=BLOCK, long=LONG):
        self.vocabulary = {t: i for i, t in enumerate(vocabulary)}
        # `bags` is read once: all bags at a time would be many times the size of the lists.
        rows = [
            (np.array([self.vocabulary[t] for t in bag], dtype=np.int32), np.array(list(bag.values()), dtype=np.int32))
            for bag in bags
        ]
        self.n = n = len(rows)
        sizes = [len(r[0]) for r in rows]
        at = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int32)])
        counts = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int32)])
        df = np.bincount(at, minlength=len(self.vocabulary))
        factors = np.array([1.0 if factors is None else factors[t] for t in vocabulary])
        self.idf = (np.log((1 + n) / (1 + df)) + 1.0) * factors
        self.ids = np.array(ids, dtype=object)
        self.ys = np.array(ys, dtype=float)
        held = np.repeat(np.arange(n, dtype=np.int32), sizes)
        w = (1.0 + np.log(counts)) * self.idf[at]
        w /= np.sqrt(np.bincount(held, w * w, n))[held]
        self.block, blocks = block, -(-n // block)
        self.order = similar_order(at, held, w, n, block)
        self.slot = np.argsort(self.order)
        spot = self.slot[held]
        is_long = df * long > n
        self.row = np.where(is_long, np.cumsum(is_long) - 1, -1)
        wide = is_long[at]
        dense = np.zeros((blocks * block, int(is_long.sum())))
        dense[spot[wide], self.row[at[wide]]] = w[wide]
        self.dense = dense
        self.coarse = dense.astype(np.float32)
        self.maxima = np.ascontiguousarray(dense.reshape(blocks, block, dense.shape[1]).max(1).T)
        self.norms = np.sqrt((dense * dense).sum(1)).reshape(blocks, block)
        short = np.nonzero(~wide)[0]
        short = short[np.argsort(at[short], kind="stable")]
        self.places, self.weights = spot[short].astype(np.min_scalar_type(max(n, 1))), w[short]
        self.starts = np.concatenate([[0], np.cumsum(np.where(is_long, 0, df))]).astype(np.int64)
        self.opened = 0  # texts whose long lists were read so far
        self.held = {}

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    def room(self, name, n, dtype):
        """An array that queries use one after the other: fresh memory for each would cost more than the sums."""
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(2 * n, dtype)
        return self.held[name][:n]

    def vector(self, bag):
        """Numbers and weights of the known terms; over all terms the weights have unit length."""
        numbers = np.array([self.vocabulary.get(t, len(self.vocabulary)) for t in bag], dtype=np.int64)
        return self.weigh(numbers, np.array(list(bag.values()), dtype=float))

    def weigh(self, numbers, counts):
        if not len(numbers):
            return numbers, np.zeros(0)
        known = numbers < len(self.vocabulary)
        idf = np.full(len(numbers), math.log(1 + self.n) + 1.0)
        idf[known] = self.idf[numbers[known]]
        w = (1.0 + np.log(counts)) * idf
        return numbers[known], w[known] / math.sqrt(float(w @ w))

    def short_sums(self, at, w):
        """Sums of the short lists of the terms, by block and place."""
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        if not sizes.all():
            first, w, sizes = first[sizes > 0], w[sizes > 0], sizes[sizes > 0]
        if not len(sizes):
            return np.zeros(self.norms.size)
        # Entry numbers as steps of 1 and, where a list ends, the step to the next one.
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        entries = self.room("entries", total, np.int64)
        entries.fill(1)
        entries[0] = first[0]
        entries[ends[:-1]] = first[1:] - (first + sizes - 1)[:-1]
        np.cumsum(entries, out=entries)
        places = self.places.take(entries, out=self.room("places", total, self.places.dtype), mode="clip")
        weights = self.weights.take(entries, out=self.room("weights", total, float), mode="clip")
        weights *= np.repeat(w, sizes)
        return np.bincount(places, weights, self.norms.size)

    def bounds(self, at, w):
        """By block and place: sums over the short lists, and bounds of the cosines. Also the weights of the long lists."""
        rows = self.row[at]
        wide = rows >= 0
        sums = self.short_sums(at[~wide], w[~wide])
        sums = sums.reshape(self.norms.shape)
        query = np.zeros(self.dense.shape[1])
        query[rows[wide]] = w[wide]
        most = np.einsum("i,ij->j", w[wide], self.maxima[rows[wide]])  # no BLAS: its threads cost more than the sums
        return sums, query, sums + np.minimum(most[:, None], self.norms * math.sqrt(float(query @ query)))

    def coarse_sums(self, slots, query, step=128):
        """Sums of the long lists of texts in single precision."""
        sums, width = np.empty(len(slots), np.float32), self.coarse.shape[1]
        for k in range(0, len(slots), step):
            some = slots[k : k + step]
            rows = self.room("rows", len(some) * width, np.float32).reshape(len(some), width)
            self.coarse.take(some, axis=0, out=rows, mode="clip")
            np.einsum("ij,j->i", rows, query, out=sums[k : k + step])
        return sums

    def nearest(self, bag, k=NEIGHBOURS, leave_out=None):
        """(cosine, position) of the k nearest with a cosine above zero, best first; ties by position."""
        return self.search(*self.vector(bag), k, leave_out)

    def search(self, at, w, k=NEIGHBOURS, leave_out=None):
        if not len(at):
            return []
        sums, query, bound = (x.ravel() for x in self.bounds(at, w))
        out = -1 if leave_out is None else int(self.slot[leave_out])

        def cosines_of(slots):
            cosines = sums[slots] + np.einsum("ij,j->i", self.dense[slots], query)
            cosines[slots == out] = 0.0
            some = cosines > 0
            return cosines[some], self.order[slots[some]]

        # The highest bounds first: their k-th best rules out most of the rest.
        first = np.zeros(len(bound), dtype=bool)
        first[np.argpartition(-bound, 2 * k)[: 2 * k] if len(bound) > 2 * k else slice(None)] = True
        self.opened += int(first.sum())
        cosines, hits = cosines_of(np.nonzero(first)[0])
        least = np.partition(cosines, -k)[-k] if len(cosines) >= k else 0.0
        rest = np.nonzero((bound >= least - 1e-9) & (bound > 0) & ~first)[0]
        self.opened += len(rest)
        # Single precision errs by less than 1e-5 here.
        rest = rest[sums[rest] + self.coarse_sums(rest, query.astype(np.float32)) >= least - 1e-5]
        if len(rest):
            more, places = cosines_of(rest)
            cosines, hits = np.concatenate([cosines, more]), np.concatenate([hits, places])
        best = np.lexsort((hits, -np.round(cosines, 12)))[:k]  # sums of equal texts may differ in the last bits
        return list(zip(cosines[best].tolist(), hits[best].tolist()))

    def shown(self, near):
        """The neighbours of many texts as an Arrow array."""
        flat = [x for found in near for x in found]
        places = np.array([p for _, p in flat], dtype=np.int64)
        ids, ys = pa.array(self.ids[places], pa.int64()), pa.array(self.ys[places].astype(np.int32))
        each = pa.StructArray.from_arrays([ids, pa.array([s for s, _ in flat], pa.float64()), ys], ["doc_id", "cosine", "toxic"])
        stops = np.concatenate([[0], np.cumsum([len(found) for found in near])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(stops), each)

    def vote(self, near):
        """Features of a vote: weighted share of toxic neighbours, its certainty, the best cosine."""
        if not near:
            return [0.0, 0.0, 0.0]
        weights = np.array([1.0 / (1.05 - s) for s, _ in near])
        ys = self.ys[[p for _, p in near]]
        share = float(weights @ ys / weights.sum())
        return [share, (share - 0.5) * float(np.log1p(weights.sum())), near[0][0]]


def fit(sample, counts):
    """Index and calibration. Each sampled text is scored without itself."""
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = (counts.get(1, 0) + 1) / (total + 2)
    ys = [y for _, _, y in sample]
    if min(ys.count(0), ys.count(1)) < 4:
        return None, prior
    weights = class_weights(ys, counts)
    bags = lambda: (terms(text) for _, text, _ in sample)
    factors = strengths(bags(), ys, weights)
    if not factors:
        return None, prior
    index = BlockMaxIndex(sorted(factors), bags(), [i for i, _, _ in sample], ys, factors)
    near = [index.nearest(bag, leave_out=at) for at, bag in enumerate(bags())]
    votes = [index.vote(x) for x in near]
    found = [bool(x) for x in near]
    empty = [(y, w) for y, w, f in zip(ys, weights, found) if not f]
    none = (sum(w for y, w in empty if y) + prior) / (sum(w for _, w in empty) + 1.0)
    model = None
    if any(found):
        pick = [i for i, f in enumerate(found) if f]
        model = fit_logistic([votes[i] for i in pick], [ys[i] for i in pick], [weights[i] for i in pick])
        index.limits = np.min([votes[i] for i in pick], 0), np.max([votes[i] for i in pick], 0)
    return (index, model, none), prior


EVIDENCE = "struct<score:double,neighbours:array<struct<doc_id:bigint,cosine:double,toxic:int>>>"


def score_toxicity(docs, labels, seen, per_class=PER_CLASS, max_bytes=MAX_BYTES):
    """The probability that a text is toxic, with the labelled texts that say so.

    Terms are all words and word beginnings; those that go with the label in a bounded
    sample weigh more. A text's nearest sampled texts by TF-IDF cosine vote with weights that grow as
    the distance falls; logistic calibration on leave-one-out votes, weighted to the
    class shares of all labels, turns the vote into a probability; votes count as far as
    the sample's own reach, so a text that the sample holds itself is not extrapolated. A text that
    shares no term with the sample has no neighbours and gets the toxic share of such texts.

    Returns doc_id, score, neighbours (doc_id, cosine, label: those that voted), one row per input
    row, every text read whole. NULL texts score like ''. Repeated rows score
    alike; a NULL doc_id is scored. With no usable labels every score is the
    smoothed prior. Extra columns are ignored. Scoring shuffles nothing.
    """
    sample, counts = labelled_sample(docs, labels, "toxic", seen, per_class, max_bytes)
    fitted, prior = fit(sample, counts)
    if fitted is None:
        nobody = F.array().cast("array<struct<doc_id:bigint,cosine:double,toxic:int>>")
        return docs.select("doc_id", F.lit(float(prior)).alias("score"), nobody.alias("neighbours"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # bounded by the sample

    @F.arrow_udf(EVIDENCE)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, model, none = shared.value
        reader = TermReader(index.vocabulary)
        for batch in texts:
            near = [index.search(*index.weigh(*read)) for read in reader.read_all(batch.to_pylist())]
            scores = np.full(len(near), none)
            pick = [i for i, found in enumerate(near) if found] if model else []
            if pick:
                scores[pick] = logistic(model, np.clip([index.vote(near[i]) for i in pick], *index.limits))
            yield pa.StructArray.from_arrays([pa.array(scores), index.shown(near)], ["score", "neighbours"])

    judged = docs.select("doc_id", judge(F.coalesce("text", F.lit(""))).alias("j"))
    return judged.select("doc_id", "j.score", "j.neighbours")

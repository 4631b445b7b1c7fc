"""Quality by compression: which of two zstandard dictionaries shortens a text more."""

import math
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import functions as F

from levelcast.llm.samples import class_weights, fit_logistic, labelled_sample, logistic

PIECE = 1024  # bytes compressed at a time: a dictionary only helps the start of a long text
DICTIONARY = 64 * 1024
LEVEL = 3
PER_CLASS = 2000
MAX_BYTES = 16_000_000
MIN_PIECE = 100  # shorter pieces do not count for the worst piece


def pieces(text):
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]


def build_dictionary(texts):
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    samples = [p for t in texts for p in pieces(t) if p]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY] or b"\0" * 8


class Gauge:
    """Sizes of a text under both dictionaries, as numbers without a unit."""

    def __init__(self, good, bad):
        make = lambda data: zstandard.ZstdCompressor(
            level=LEVEL,
            dict_data=zstandard.ZstdCompressionDict(data),
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )
        self.good, self.bad = make(good), make(bad)

    def __call__(self, text):
        """Normalised size difference of the whole and of the worst piece, and log of the compression ratio."""
        g_all = b_all = n_all = 0
        worst = None
        for piece in pieces(text):
            g, b = len(self.good.compress(piece)), len(self.bad.compress(piece))
            g_all, b_all, n_all = g_all + g, b_all + b, n_all + len(piece)
            if len(piece) >= MIN_PIECE:
                apart = (b - g) / (b + g)
                worst = apart if worst is None else min(worst, apart)
        whole = (b_all - g_all) / (b_all + g_all)
        ratio = math.log((g_all + b_all) / 2 / max(n_all, 1))
        return [whole, whole if worst is None else worst, ratio, min(ratio, -0.9), math.log1p(n_all)]


def fit(sample, counts):
    """Dictionaries from every other sampled text, calibration on the rest.

    Without texts of both classes there is nothing to tell apart: the score is then
    the share of good labels, smoothed.
    """
    total = counts.get(0, 0) + counts.get(1, 0)
    prior = (counts.get(1, 0) + 1) / (total + 2)
    by = {y: [t for _, t, label in sample if label == y] for y in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return None, prior
    good, bad = build_dictionary(by[1][::2]), build_dictionary(by[0][::2])
    gauge = Gauge(good, bad)
    rest = [(t, y) for y in (0, 1) for t in by[y][1::2]]
    ys = [y for _, y in rest]
    model = fit_logistic([gauge(t) for t, _ in rest], ys, class_weights(ys, counts))
    return (good, bad, model), prior


def score_quality(docs, labels, seen, per_class=PER_CLASS, max_bytes=MAX_BYTES):
    """The probability that a text is good, from compressed sizes only.

    Two dictionaries are built from a bounded sample of good and of bad texts; the
    normalised difference of a text's sizes under them, whole and piece by piece,
    becomes a probability by logistic calibration on sampled texts that the
    dictionaries have not seen, weighted to the class shares of all labels.

    Returns doc_id and score, one row per input row, every text read whole. NULL
    texts score like ''. Repeated rows score alike; a NULL doc_id is scored. With
    no usable labels every score is the smoothed prior. Extra columns are ignored.
    Scoring is a map over the rows: nothing is shuffled.
    """
    sample, counts = labelled_sample(docs, labels, "quality", seen, per_class, max_bytes)
    fitted, prior = fit(sample, counts)
    if fitted is None:
        return docs.select("doc_id", F.lit(float(prior)).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)  # two dictionaries and six numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad, model = shared.value
        gauge = Gauge(good, bad)
        for batch in texts:
            yield pd.Series(logistic(model, [gauge(t or "") for t in batch]) if len(batch) else [], dtype="float64")

    return docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))

"""Bounded labelled samples and the calibration fitted on them."""

import numpy as np
from pyspark.sql import functions as F

from levelcast.llm.common import stable_hash


def labelled_sample(docs, labels, target, seen, per_class, max_bytes):
    """Labelled texts for a fit on the driver: at most `per_class` per label and `max_bytes` in all.

    `seen` tells, from doc_id, which labels may be used. Documents are taken whole,
    in the order of a hash of doc_id, so a rerun takes the same; one that does not
    fit into the rest of the byte bound is passed over. The size of the sample does
    not grow with the data. Also returns how many labelled documents of each class
    there are, for the prior: counted over all labels.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & seen(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = stable_hash(F.col("doc_id"))
    ids = {}
    for y in (0, 1):
        first = known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class)
        ids |= {r["doc_id"]: (y, k) for k, r in enumerate(first.collect())}
    if not ids:
        return [], counts
    chosen = docs.filter(F.col("doc_id").isin(list(ids)) & F.col("text").isNotNull())
    sized = chosen.select("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    sized = sized.groupBy("doc_id").agg(F.min(F.struct("h", "n")).alias("x")).collect()
    room, take = {0: max_bytes // 2, 1: max_bytes // 2}, {}
    for row in sorted(sized, key=lambda r: ids[r["doc_id"]][1]):
        y = ids[row["doc_id"]][0]
        if row["x"]["n"] <= room[y]:
            room[y] -= row["x"]["n"]
            take[row["doc_id"]] = row["x"]["h"]
    texts = chosen.filter(F.col("doc_id").isin(list(take))).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(
        F.first("text").alias("text")
    )
    rows = [r for r in texts.collect() if take[r["doc_id"]] == r["h"]]
    rows.sort(key=lambda r: ids[r["doc_id"]][::-1])
    return [(r["doc_id"], r["text"], ids[r["doc_id"]][0]) for r in rows], counts


def fit_logistic(x, y, weights, ridge=1e-2, rounds=40):
    """Weighted ridge logistic regression by Newton steps: means, scales, coefficients, intercept last."""
    x, y, weights = np.asarray(x, float), np.asarray(y, float), np.asarray(weights, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weights * (p - y)) + penalty @ beta
        hessian = (z * (weights * p * (1 - p) + 1e-9)[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def logistic(model, x):
    mean, scale, beta = model
    z = (np.asarray(x, float) - mean) / scale
    return 1 / (1 + np.exp(-np.clip(z @ beta[:-1] + beta[-1], -30, 30)))


def class_weights(y, counts):
    """Weights that give a sample the class shares of all labelled documents."""
    y = np.asarray(y)
    total = sum(counts.values()) or 1
    share = {c: counts.get(c, 0) / total for c in (0, 1)}
    size = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    return np.array([share[c] / size[c] for c in y]) * len(y)

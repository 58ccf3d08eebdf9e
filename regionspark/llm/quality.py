"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled good) and unlabelled web text (rows of the
corpus, whatever their label) train a small network on dense text features by
minimising the non-negative unbiased risk

    R(f) = prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

with logistic loss, so that sigmoid(f) estimates the chance of a good text.
Rows labelled bad are never used. The class prior is estimated from the same
two samples: over scores s that separate them, the least ratio of shares
U(f >= s) / P(f >= s), where only good texts are left.

Both samples are bounded (MAX_POSITIVE, MAX_UNLABELLED rows, chosen by a hash of
doc_id and text), which bounds what reaches the driver; only the features of
these are computed for the fit. Features and scores are computed where the
texts are, in one pass over all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import carry, hash_sample, held_out, materialize, pick, tidy, unpack
from .textfeat import QUALITY_FEATURES, quality_features

#: Most rows that either sample of the fit has.
MAX_POSITIVE = 10_000
MAX_UNLABELLED = 20_000
#: A text scoring at least this is kept.
THRESHOLD = 0.3
#: Without a trusted positive there is nothing to learn: every text gets this score.
UNKNOWN = 1.0
HIDDEN = 24
#: The fit uses this part of the estimated prior: the estimate is an upper bound, and too
#: high a prior explains bad texts away, while one too low only shaves the scores of good ones.
PRIOR_MARGIN = 0.95


def _matrix(texts) -> np.ndarray:
    """The dense features of each text."""
    return np.array([quality_features(t.as_py() or "") for t in texts], float).reshape(-1, len(QUALITY_FEATURES))


def _samples(docs: DataFrame, trusted: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most MAX_POSITIVE documents in trusted (__d) and of MAX_UNLABELLED of all, in the order of a hash, so that reruns agree.

    Ids and hashes of texts are drawn first; of the texts only those drawn are looked at.
    """
    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.xxhash64(F.col(text)).alias("stamp"), F.col(text).alias("text")).where("doc_id is not null")
    keys = rows.select("doc_id", "stamp")
    p = hash_sample(keys.join(trusted, F.col("doc_id") == F.col("__d"), "left_semi"), MAX_POSITIVE, "doc_id", "stamp")
    u = hash_sample(keys, MAX_UNLABELLED, "doc_id", "stamp")
    drawn = p.withColumn("trusted", F.lit(True)).unionByName(u.withColumn("trusted", F.lit(False))).distinct()
    drawn = materialize(drawn.select(F.col("doc_id").alias("__d"), F.col("stamp").alias("__s"), "trusted"), "quality-drawn")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(_matrix(b.column(3))), pa.list_(pa.float64()))], names=["doc_id", "stamp", "trusted", "x"])

    # at most MAX_POSITIVE + MAX_UNLABELLED rows of 17 bytes are broadcast
    texts = rows.join(F.broadcast(drawn), (F.col("doc_id") == F.col("__d")) & (F.col("stamp") == F.col("__s"))).select("doc_id", "stamp", "trusted", "text")
    feats = texts.mapInArrow(tidy(run), "doc_id long, stamp long, trusted boolean, x array<double>").dropDuplicates(["doc_id", "stamp", "trusted"])
    got = feats.withColumn("u", F.xxhash64("doc_id", "stamp")).toPandas().sort_values(["u", "doc_id", "stamp"])
    return tuple(np.array(got["x"][got["trusted"] == side].tolist(), float).reshape(-1, len(QUALITY_FEATURES)) for side in (True, False))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


class Network:
    """One hidden layer on standardised features, kept as plain arrays."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.parts = (mean, scale, w1, b1, w2, b2)

    def logit(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.parts
        z = np.clip((x - mean) / scale, -8, 8)
        return np.tanh(z @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def risk_gradient(w: list[np.ndarray], xp: np.ndarray, xu: np.ndarray, prior: float | None) -> tuple[float, float, list[np.ndarray]]:
    """(positive part, negative part, gradient) of the risk of weights w on positives and unlabelled rows.

    The risk is the sum of both parts, the second one bounded by 0 from below.
    Where it falls below 0 the gradient leads it up again and leaves the first
    part alone. Without a prior the parts are the mean losses of P against U.
    """
    x = np.concatenate([xp, xu])
    h = np.tanh(x @ w[0] + w[1])
    f = h @ w[2] + w[3][0]
    fp, fu = f[: len(xp)], f[len(xp) :]
    if prior is None:
        positive, negative = _softplus(-fp).mean(), _softplus(fu).mean()
        gp, gu = -_sigmoid(-fp) / len(fp), _sigmoid(fu) / len(fu)
    else:
        positive, negative = prior * _softplus(-fp).mean(), _softplus(fu).mean() - prior * _softplus(fp).mean()
        gp, gu = -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        if negative >= 0:
            gp = gp - prior * _sigmoid(-fp) / len(fp)
        else:
            gp, gu = -gp, -gu
    g = np.concatenate([gp, gu])
    back = g[:, None] * w[2] * (1 - h * h)
    return positive, negative, [x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]


def fit_network(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 512, seed: int = 5, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Non-negative PU risk with the given prior; without one, plain P against U (for estimating it)."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    d = both.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (p, u))
    step = 0
    rounds = max(1, len(u) // batch)
    for epoch in range(epochs):
        op, ou = rng.permutation(len(zp)), rng.permutation(len(zu))
        for k in range(rounds):
            xp = zp[op[np.arange(k * batch, (k + 1) * batch) % len(zp)]]
            xu = zu[ou[k * batch : (k + 1) * batch]] if len(zu) >= batch else zu
            _, _, grads = risk_gradient(w, xp, xu, prior)
            grads[0], grads[2] = grads[0] + decay * w[0], grads[2] + decay * w[2]
            step += 1
            lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for i in range(4):
                m[i] = 0.9 * m[i] + 0.1 * grads[i]
                v[i] = 0.999 * v[i] + 0.001 * grads[i] ** 2
                w[i] = w[i] - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, w[0], w[1], w[2], w[3][0])


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 5) -> float:
    """The share of good texts among the unlabelled: out-of-fold scores, then the least ratio of upper tails."""
    half_p, half_u = np.arange(len(p)) % 2 == 0, np.arange(len(u)) % 2 == 0
    if half_p.sum() < 2 or (~half_p).sum() < 2 or (~half_u).sum() < 2:
        return 0.5
    ratios = []
    for a, b in ((half_p, half_u), (~half_p, ~half_u)):
        net = fit_network(p[a], u[b], None, epochs=20, seed=seed)
        sp, su = np.sort(net.logit(p[~a])), np.sort(net.logit(u[~b]))
        # tails that hold a tenth of the positives at least, with a bound for chance
        cut = np.quantile(sp, np.linspace(0.0, 0.9, 46))
        tail_p = 1 - np.searchsorted(sp, cut) / len(sp)
        tail_u = 1 - np.searchsorted(su, cut) / len(su)
        slack = np.sqrt(np.maximum(tail_u * (1 - tail_u), 1e-4) / len(su)) + tail_u / tail_p * np.sqrt(tail_p * (1 - tail_p) / len(sp))
        ratios.append(float(np.min((tail_u + slack) / tail_p)))
    return float(np.clip(np.mean(ratios), 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", quality: str = "quality") -> tuple[Network | None, float]:
    """(network, class prior) from documents and labels (doc_id, quality).

    Held-out rows give no label. Null ids or labels are ignored, as are labels
    without a document; an id labelled both ways is not trusted.
    """
    trusted = pick(labels, "doc_id", quality).where(F.col("doc_id").isNotNull() & F.col(quality).isNotNull() & ~held_out(F.col("doc_id")))
    trusted = trusted.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.min(quality).alias("q")).where("q = 1").select("__d")
    p, u = _samples(docs, trusted, text)
    if len(p) < 2:
        return None, UNKNOWN
    prior = estimate_prior(p, u)
    return fit_network(p, u, PRIOR_MARGIN * prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score.

    Null and empty texts are scored by their (zero) features, texts of any
    length by all of theirs; null doc_ids are scored, never learned from; equal
    rows score alike; extra columns don't matter; an empty table gives no rows;
    without a trusted positive every score is UNKNOWN.
    """
    net, _ = fit(docs, labels, text)

    def run(batches):
        for b in batches:
            s = net.score(_matrix(b.column(1))) if net is not None else np.full(b.num_rows, UNKNOWN)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    rows = pick(docs, "doc_id", text).select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep_quality(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` at least, with all their columns and as often as they are there.

    Rows score as in score_quality, each by its own text in the pass that keeps
    it, so nulls and repeats in doc_id don't matter; null and empty texts are
    scored, too. Without a trusted positive all rows stay. Texts may be of any
    length; extra columns, whatever their names, don't matter; an empty table
    stays empty.
    """
    net, _ = fit(docs, labels, text)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(_matrix(texts)) if net is not None else np.full(len(texts), UNKNOWN))

    return unpack(carry(docs, text).where(score(F.col(text)) >= threshold), docs)

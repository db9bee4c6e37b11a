"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; every other text is unlabelled,
a mixture of both kinds. The share of good ones in it, the class prior, is
estimated: for any set A of texts P_unlabelled(A) >= prior * P_positive(A), so
the smallest ratio (with its sampling error) over the upper sets of a
positive-against-unlabelled score bounds it. A logistic model then minimises the
non-negative unbiased risk
    prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]),
ascending on the second part wherever it falls below zero. Labels 0 are not used.

The fit sees at most about `sample` positives and as many unlabelled texts, drawn
by a hash of their ids; scoring covers every whole text. Defined cases: null and
empty texts have the features of an empty text and are scored; a document with
several labels is trusted only if all are 1; without trusted positives every
score is 0.5; columns with the names of new ones give way to them.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, with_columns_beside, with_columns_from

MARKS = string.punctuation.encode()
N_FEATURES = 2 * (len(MARKS) + 19)


def features(text: bytes | None) -> np.ndarray:
    """Shape of a text: shares of kinds of characters, words and lines; and their squares, so that both ends can count."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    kinds = [counts[list(MARKS)], [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum(), counts[32], counts[10]]]
    shares = np.log1p(np.concatenate(kinds) * (1000.0 / n))
    tokens = text.split()
    m = max(1, len(tokens))
    seen = Counter(tokens)
    lines = [x for x in text.split(b"\n") if x.strip()]
    rows = Counter(lines)
    sizes = np.fromiter(map(len, tokens), np.float64, len(tokens))
    caps = sum(x.isupper() for x in tokens)
    titles = sum(x.istitle() for x in tokens)
    again = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    plain = sum(x.isalpha() for x in tokens)
    extra = [
        np.log1p(len(text)),
        np.log1p(len(tokens)),
        np.log1p(len(lines)),
        sizes.mean() if len(sizes) else 0.0,
        sizes.std() if len(sizes) else 0.0,
        np.log((len(seen) + 1) / (len(tokens) + 1)),
        max(seen.values(), default=0) / m,
        1 - len(rows) / max(1, len(lines)),
        max(rows.values(), default=0) / max(1, len(lines)),
        caps / m,
        titles / m,
        plain / m,
        np.log1p(1000.0 * again / m),
    ]
    values = np.concatenate([shares, extra]).astype(np.float32)
    return np.concatenate([values, values * values])


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """Share of positives among `unlabelled`: a score is learned on the even rows, the ratio bound taken on the odd ones."""
    p0, u0, p1, u1 = positive[::2], unlabelled[::2], positive[1::2], unlabelled[1::2]
    if not len(p1) or not len(u1):
        return 0.5

    def gradient(w: np.ndarray) -> np.ndarray:
        return u0.T @ _sigmoid(u0 @ w) / len(u0) - p0.T @ _sigmoid(-(p0 @ w)) / len(p0) + 1e-3 * w

    w = _adam(gradient, positive.shape[1], steps, 0.05)
    sp, su = np.sort(p1 @ w), np.sort(u1 @ w)
    best = 1.0
    for t in np.quantile(sp, np.linspace(0.0, 0.7, 71)):
        a, b = 1 - np.searchsorted(sp, t) / len(sp), 1 - np.searchsorted(su, t) / len(su)
        low = a - 1.64 * np.sqrt(a * (1 - a) / len(sp))
        if low > 0:
            best = min(best, (b + 1.64 * np.sqrt(b * (1 - b) / len(su))) / low)
    return float(np.clip(best, 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, rate: float = 0.03, decay: float = 1e-4) -> Model:
    """Non-negative unbiased risk with logistic loss, by full-batch Adam."""
    centre = unlabelled.mean(0)
    scale = unlabelled.std(0) + 1e-3
    tidy = lambda x: np.hstack([np.clip((x - centre) / scale, -8, 8), np.ones((len(x), 1))])
    p, u = tidy(positive), tidy(unlabelled)
    prior = estimate_prior(p, u)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        of_negative = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        if negative < 0:
            return -of_negative
        return of_negative - prior * (p.T @ _sigmoid(-zp)) / len(p) + decay * w

    w = _adam(gradient, p.shape[1], steps, rate)
    return Model(centre, scale, w[:-1], float(w[-1]), prior)


def draw(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows of `df`, or all if there are fewer: those of the smallest hashes of the row, so the same ones in every layout. Rows that are equal count each."""
    mark = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    least = sorted(r["_mark"] for r in df.select(mark.alias("_mark")).orderBy("_mark").limit(n + 1).collect())  # n + 1 numbers
    if len(least) <= n:
        return df
    last = least[n - 1]
    return df.where(mark < last).unionByName(df.where(mark == last).limit(n - least.index(last)))  # the latter are equal


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 12_000) -> Model | None:
    """labels (doc_id, quality) where `allowed` (a condition on doc_id) says they may be learned from."""
    trusted = labels.where(allowed & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")
    chosen = draw(trusted, sample, 1).withColumn("positive", F.lit(1))
    texts = docs.select("doc_id", "text")
    positives = draw(texts.join(F.broadcast(chosen), "doc_id"), sample, 1)  # ids may have any number of rows
    unlabelled = draw(texts, sample, 2).withColumn("positive", F.lit(0))
    both = positives.unionByName(unlabelled)
    kept = with_columns_from(both, lambda b: [pa.array([features(x.as_py()) for x in b.column(0)], pa.list_(pa.float32()))], "x array<float>", {"text": as_bytes()}, ["doc_id", "positive"])
    got = kept.toArrow()  # about 2 * sample rows of N_FEATURES numbers
    if not got.num_rows:
        return None
    sign = got.column("positive").to_numpy()
    x = np.array(got.column("x").combine_chunks().flatten().to_numpy(), np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T[:4], got.column("doc_id").to_numpy(), sign))  # the same rows in the same order on every cluster
    x, sign = x[order], sign[order]
    # rows of one document lie together, so a fixed shuffle mixes them
    mixed = np.random.default_rng(7).permutation(len(x))
    x, sign = x[mixed], sign[mixed]
    if not sign.any() or sign.all():
        return None
    return fit(x[sign == 1], x[sign == 0])


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Adds `score` (probability of quality) and `predicted`."""

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(0)
        if model is None or not len(texts):
            scores = np.full(len(texts), 0.5)
        else:
            scores = np.concatenate([model.score(np.stack([features(t.as_py()) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)])
        return [pa.array(scores.astype(np.float64)), pa.array((scores >= threshold).astype(np.int32))]

    return with_columns_beside(docs, run, "score double, predicted int", {"text": as_bytes()}, docs.columns if keep is None else keep)

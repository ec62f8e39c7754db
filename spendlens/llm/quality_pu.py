"""Positive-unlabelled quality classifier.

Trusted positives (texts labelled good) and unlabelled web text give an unbiased estimate of the classification risk,
    pi R_p(+1) + R_u(-1) - pi R_p(-1),
whose last two terms estimate the risk on negatives and must not fall below zero; where they do on a batch, the
step goes back along them instead (non-negative risk).  The class prior pi is estimated first, from the same two
samples: a classifier of positives against unlabelled text is fitted on one half, and pi is the least ratio, over
thresholds, of the share of unlabelled to the share of positive texts above it in the other half (at most 0.99).
Features are hashed words and word shapes, and ratios such as adjacent repeats.

Defined results: null and empty texts get the score of an empty text; a null doc_id is scored and never learnt from;
repeated rows score alike, and of rows with the same doc_id the least text is learnt from; without positives all scores are 0.5; an empty table gives an empty result; all columns of
the input are kept.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear


def features(word: str) -> list[str]:
    """The word in lower case, its shape (letters, digits and marks, runs squeezed) and its end."""
    shape, last = [], ""
    for c in word[:24]:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
            last = kind
    return ["w" + word.lower(), "s" + "".join(shape), "e" + word[-2:]]


def ratios(words: list[str]) -> list[float]:
    """Shares of adjacent repeats and of different words, words in capitals or ending in a mark, lone marks, log length."""
    n = max(1, len(words))
    repeats = sum(map(eq, words, words[1:])) / n
    marks = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words) / n
    capitals = sum(map(str.isupper, words)) / n
    lone = sum(not w[0].isalnum() for w in words) / n
    return [3 * repeats, len(set(words)) / n, 3 * marks, 3 * capitals, 3 * lone, float(np.log1p(n)) / 10]


def _descend(p: list[dict], u: list[dict], prior: float, epochs: int, rate: float, decay: float, seed: int) -> np.ndarray:
    """Weights with the least non-negative risk; prior 0 fits positives against unlabelled texts plainly."""
    width = len(ratios([]))
    model = linear.Adagrad((1 << linear.BITS) + width + 1, rate, decay)
    rng = np.random.default_rng(seed)
    steps = max(1, (len(p) + len(u)) // 256)
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
        for a, b in zip(ps, us, strict=True):
            if not len(a) or not len(b):
                continue
            x, y = linear.Batch([p[k] for k in a], width), linear.Batch([u[k] for k in b], width)
            zp, zu = x.dot(model.w), y.dot(model.w)
            sp, su = linear.sigmoid(zp), linear.sigmoid(zu)
            if not prior:
                model.step(x.back(sp - 1) / len(a) + y.back(su) / len(b))
                continue
            # logistic loss: l(z, +1) = log(1 + e^-z), l(z, -1) = log(1 + e^z)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            on_negatives = y.back(su) / len(b) - prior * x.back(sp) / len(a)
            if negative >= 0:
                model.step(prior * x.back(sp - 1) / len(a) + on_negatives)
            else:
                model.step(-on_negatives)
    return model.w


def estimate_prior(p: list[dict], u: list[dict], epochs: int, rate: float, decay: float, seed: int) -> float:
    """The share of positives among unlabelled texts."""
    width = len(ratios([]))
    w = _descend(p[::2], u[::2], 0.0, epochs, rate, decay, seed)
    sp, su = (np.sort(linear.Batch(x[1::2], width).dot(w)) for x in (p, u))
    if len(sp) < 10 or len(su) < 10:
        return 0.5
    at = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    above_p = 1 - np.searchsorted(sp, at, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, at, "left") / len(su)
    slack = 1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su))
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positives: DataFrame, unlabelled: DataFrame, epochs: int = 25, rate: float = 0.2, decay: float = 3e-3,
        seed: int = 0, prior: float | None = None) -> np.ndarray:
    """Weights from bounded tables with a column text."""
    p = linear.sample_vectors(positives.select("text", F.lit(1).alias("label")), features, ratios)
    u = linear.sample_vectors(unlabelled.select("text", F.lit(0).alias("label")), features, ratios)
    rng = np.random.default_rng(seed)
    p, u = [p[k] for k in rng.permutation(len(p))], [u[k] for k in rng.permutation(len(u))]
    if not p or not u:
        return np.zeros((1 << linear.BITS) + len(ratios([])) + 1)
    if prior is None:
        prior = estimate_prior(p, u, max(1, epochs // 4), rate, decay, seed)
    return _descend(p, u, prior, epochs, rate, decay, seed)


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, folds: int = 5, fold: int = 0,
            keep: list[str] | None = None, **options) -> DataFrame:
    """row (the columns ``keep``, all by default), score, and held_out; fitted on at most ``train_rows`` texts labelled 1 and as many
    unlabelled ones, none from the held-out fold."""
    learn = ~linear.held_out(F.col("doc_id"), folds, fold)
    good = labels.where(F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(
        F.min(F.col("quality").cast("int")).alias("q")).where("q = 1").select("doc_id")
    positives = linear.texts_of(docs, linear.draw(good, train_rows, "positives"))  # at most train_rows rows
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & learn).distinct()
    unlabelled = linear.texts_of(docs, linear.draw(ids, train_rows, "unlabelled"))
    return linear.score(docs, fit(positives, unlabelled, **options), features, ratios, keep).withColumn(
        "held_out", linear.held_out(F.col("row.doc_id"), folds, fold))

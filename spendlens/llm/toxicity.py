"""Counterfactual-regularised toxicity classifier.

A logistic model over word and word-beginning features, fitted on a bounded sample of labelled texts.  In every
labelled sentence that mentions an identity term, the term is swapped for the others of its group and for a
neutral noun; the squared change of the sentence's score is a penalty.  Terms of a group thus weigh alike and as little
as the neutral noun, which lowers false alarms on neutral mentions, while words that make a text toxic keep their weight.

Defined results: null and empty texts get the score of an empty text; a null doc_id is scored and never learnt from;
repeated rows score alike, and of rows with the same doc_id the least text is learnt from; without labels of both classes all scores are the share of toxic labels (0.5 without any);
an empty table gives an empty result; all columns of the input are kept.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear

#: Terms that may be swapped for one another, by group.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
)
NEUTRAL = "people"
_STRIP = ".,!?;:\"'()[]{}*&%$#|-"


def features(word: str) -> list[str]:
    """The word without marks, and its beginnings of four to seven letters."""
    w = word.lower().strip(_STRIP)
    return [w, *("^" + w[:k] for k in (4, 5, 6, 7) if len(w) > k)] if w else []


def ratios(words: list[str]) -> list[float]:
    return []


def swaps(text: str | None, groups=IDENTITY_GROUPS) -> list[tuple[str, str]]:
    """(term, replacement) of every swap that the text's sentences allow, in order, repeats included."""
    partners = {t: [*(o for o in g if o != t), NEUTRAL] for g in groups for t in g}
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
        for w in sentence.lower().split():
            w = w.strip(_STRIP)
            out += [(w, o) for o in partners.get(w, ())]
    return out


def _swap_counts(rows: DataFrame) -> dict[tuple[str, str], int]:
    """How often the sample's sentences allow each swap; as many rows as there are pairs of terms at most."""

    def run(batches):
        for batch in batches:
            got = [s for t in batch.column("text") for s in swaps(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in got], pa.string()),
                                              pa.array([s[1] for s in got], pa.string())], ["term", "other"])

    found = rows.select("text").mapInArrow(run, "term string, other string").groupBy("term", "other").count().collect()
    return {(r["term"], r["other"]): r["count"] for r in sorted(found, key=lambda r: (r["term"], r["other"]))}


def fit(rows: DataFrame, penalty: float = 10.0, epochs: int = 40, rate: float = 0.4, decay: float = 6e-5,
        seed: int = 0) -> np.ndarray:
    """Weights from a bounded table (text, label)."""
    made = linear.sample_vectors(rows, features, ratios)
    size = (1 << linear.BITS) + 1
    labels = np.array([r["label"] for r in made], float)
    prior = labels.mean() if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        w = np.zeros(size)
        w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return w
    pairs = _swap_counts(rows)
    change = [(linear.hashed(features(a)), linear.hashed(features(b)), n / len(made)) for (a, b), n in pairs.items()]
    model = linear.Adagrad(size, rate, decay)
    model.w[-1] = np.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(made))
        for lo in range(0, len(made), 200):
            own = order[lo:lo + 200]
            x = linear.Batch([made[k] for k in own], 0)
            g = x.back(linear.sigmoid(x.dot(model.w)) - labels[own]) / len(own)
            for a, b, share in change:  # d/dw of penalty x (score change)^2
                pull = 2 * penalty * share * (model.w[a].sum() - model.w[b].sum())
                np.add.at(g, a, pull)
                np.add.at(g, b, -pull)
            model.step(g)
    return model.w


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = 8000, folds: int = 4, fold: int = 2,
             keep: list[str] | None = None, **options) -> DataFrame:
    """row (the columns ``keep``, all by default), score, and held_out; fitted on at most ``train_rows`` labelled texts of other folds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("label"))
    drawn = linear.draw(known.where(~linear.held_out(F.col("doc_id"), folds, fold)), train_rows, "toxic")
    texts = linear.texts_of(docs, drawn)  # at most train_rows rows
    return linear.score(docs, fit(texts.select("text", "label"), **options), features, ratios, keep).withColumn(
        "held_out", linear.held_out(F.col("row.doc_id"), folds, fold))

"""Hashed linear scores of whole texts: what the two classifiers share.

Every word adds a few hashed features; a text's vector holds their counts over the square root of its number of words, so
that the noise of many unknown words keeps its size at any length, plus a few dense ratios.  A score is then a sum of
per-word weights, remembered word by word in each Python worker.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
CACHE_ENTRIES = 200_000
Features = Callable[[str], list[str]]  # of a word
Ratios = Callable[[list[str]], list[float]]  # of a text's words


def hashed(names: Iterable[str]) -> list[int]:
    return [zlib.crc32(x.encode()) >> (32 - BITS) for x in names]


def vector(text: str | None, features: Features, ratios: Ratios) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(hashed ids, values, ratios) of a text."""
    words = (text or "").split()
    ids, counts = np.unique(np.array([h for w in words for h in hashed(features(w))], np.int64), return_counts=True)
    return ids, (counts / math.sqrt(max(1, len(words)))).astype(np.float32), ratios(words)


def sample_vectors(rows: DataFrame, features: Features, ratios: Ratios) -> list[dict]:
    """Vectors of a bounded sample of rows (text, label): label, ids, values, ratios."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vector(t.as_py(), features, ratios) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([m[0].astype("<u4").tobytes() for m in made], pa.binary()),
                 pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
                 pa.array([m[2] for m in made], pa.list_(pa.float64()))], ["label", "ids", "vals", "ratios"])

    out = rows.select(F.col("label").cast("int").alias("label"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "label int, ids binary, vals binary, ratios array<double>").collect()
    # a fixed order, whichever task ended first: refits agree
    return sorted((r.asDict() for r in out), key=lambda r: (r["label"], r["ids"], r["vals"]))


class Batch:
    """Texts as a sparse matrix, with the dense ratios after the hashed features and a constant at the end."""

    def __init__(self, rows: list[dict], width: int):
        ids = [np.frombuffer(r["ids"], "<u4").astype(np.int64) for r in rows]
        dense = np.array([[*r["ratios"], 1.0] for r in rows], np.float32).reshape(len(rows), width + 1)
        self.row = np.repeat(np.arange(len(rows)), [len(i) + width + 1 for i in ids])
        tail = (1 << BITS) + np.arange(width + 1)
        self.col = np.concatenate([x for i in ids for x in (i, tail)]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([x for r, d in zip(rows, dense, strict=True) for x in (np.frombuffer(r["vals"], "<f4"), d)]
                                  ) if rows else np.zeros(0, np.float32)
        self.n = len(rows)
        self.size = (1 << BITS) + width + 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * g[self.row], self.size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Adagrad:
    def __init__(self, size: int, rate: float, decay: float):
        self.w, self.seen, self.rate, self.decay = np.zeros(size), np.full(size, 1e-8), rate, decay

    def step(self, g: np.ndarray) -> None:
        g = g + self.decay * self.w
        self.seen += g * g
        self.w -= self.rate * g / np.sqrt(self.seen)


def score(docs: DataFrame, w: np.ndarray, features: Features, ratios: Ratios, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns ``keep``, all by default) and score, from 0 to 1, of every whole text (null: empty)."""
    weight, tail = w[:1 << BITS].astype(np.float32), w[1 << BITS:].tolist()

    class Known(dict):
        def __missing__(self, word: str) -> float:
            value = float(sum(weight[h] for h in hashed(features(word))))
            if len(self) < CACHE_ENTRIES and len(word) <= 40:
                self[word] = value
            return value

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        find = known.__getitem__
        for batch in batches:
            z = []
            texts = batch.column("row").field("text") if inside else batch.column("text")
            for text in texts:
                words = (text.as_py() or "").split()
                z.append(sum(map(find, words)) / math.sqrt(max(1, len(words)))
                         + sum(a * b for a, b in zip(tail, [*ratios(words), 1.0], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sigmoid(np.array(z)), pa.float64())],
                                             ["row", "score"])

    keep = keep or docs.columns
    inside = "text" in keep and docs.schema["text"].dataType.simpleString() == "string"  # then it travels once
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"),
                       *([] if inside else [F.col("text").cast("string").alias("text")]))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double")


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of doc_id as text leaves the remainder ``fold``; a null doc_id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def draw(rows: DataFrame, n: int, salt: str) -> DataFrame:
    """At most ``n`` rows (doc_id, ...), the same ones whatever the layout: those first in a seeded hash order."""
    return rows.withColumn("_h", F.xxhash64(F.lit(salt), "doc_id")).orderBy("_h", "doc_id").limit(n).drop("_h")


def texts_of(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """One row for each doc_id of a small drawn table: its columns and the least text under that id, however many rows repeat it."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy(*drawn.columns).agg(F.min("text").alias("text"))

"""Substring deduplication by sliding sentence spans.

A span is a run of several consecutive sentences (two at least, ``span_words`` words at least; a single sentence
counts from twice as many words on): for every sentence the shortest one that starts and the shortest one that
ends there.  So every sentence of a repeated passage of 2 x ``span_words`` words lies in a span wholly inside
it.  Spans are hashed (128 bits, from per-sentence hashes, so that all spans of a text cost one pass) and joined globally;
the first occurrence, by doc_id and place, stays, and sentences covered by any later one are removed.

The first pass keeps only 64-bit hashes seen twice (combined before the shuffle), the second only occurrences of
those; a passage that a third of all documents share meets nowhere but in combined aggregates and in joins that AQE
can split.

Sentences end at ``.``, ``!`` or ``?`` before white space, or at a line feed; they are compared in lower case with white
space squeezed, and removed with the white space after them.

Defined results: null and empty texts stay as they are; rows that repeat both doc_id and text are one document and are
cleaned alike; a null doc_id comes first; an empty table gives an empty result; all columns of the input are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

_END = re.compile(r"((?<=[.!?])\s+|\n\s*)")
_B = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
_INVERSE = pow(_B, -1, 1 << 64)


def split_sentences(text: str) -> tuple[list[str], list[list[str]], np.ndarray]:
    """Pieces (sentence, white space, sentence, ...), the words of each sentence that has any, and its piece."""
    pieces = _END.split(text)
    words = [s.lower().split() for s in pieces[::2]]
    own = [k for k, w in enumerate(words) if w]
    return pieces, [words[k] for k in own], 2 * np.array(own, np.int64)


def span_bounds(lengths: np.ndarray, span_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the spans of a text whose sentences have so many words."""
    n = len(lengths)
    total = np.r_[0, np.cumsum(lengths)]
    here = np.arange(n)

    def last(t):  # of the shortest run from each sentence on
        two = np.maximum(np.searchsorted(t, t[:-1] + span_words, "left") - 1, here + 1)
        return np.where(np.diff(t) >= 2 * span_words, here, two)

    end = last(total)
    begin = (n - 1) - last(total[-1] - total[::-1])[::-1]
    a, b = np.r_[here, begin], np.r_[end, here]
    fine = (b < n) & (a >= 0)
    both = np.unique(a[fine] * (n + 1) + b[fine])
    return both // (n + 1), both % (n + 1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def spans(text: str | None, span_words: int) -> tuple[np.ndarray, ...]:
    """(hash, second hash, first sentence, last sentence) of a text's spans."""
    import xxhash

    none = np.zeros(0, np.int64)
    if not text:
        return none, none, none, none
    _, words, _ = split_sentences(text)
    if not words:
        return none, none, none, none
    first, last = span_bounds(np.array([len(w) for w in words]), span_words)
    if not len(first):
        return none, none, none, none
    digest = b"".join([xxhash.xxh3_128_digest(" ".join(w)) for w in words])
    power, inverse = _powers(len(words), _B), _powers(len(words), _INVERSE)
    out = []
    for own in np.frombuffer(digest, "<u8").reshape(-1, 2).T:
        run = np.r_[np.uint64(0), np.cumsum(own * power[:-1], dtype=np.uint64)]
        mixed = (run[last + 1] - run[first]) * inverse[first] + (last - first).astype(np.uint64)
        mixed ^= mixed >> np.uint64(31)
        out.append((mixed * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return out[0], out[1], first, last


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def span_table(docs: DataFrame, span_words: int, full: bool = True) -> DataFrame:
    """(h), or with ``full`` (h, g, doc_id, key, first, last), for every span of every document."""
    schema = "h long, g long, doc_id long, key long, first int, last int" if full else "h long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                found = [spans(t.as_py(), span_words) for t in some.column("text")]
                many = [len(x[0]) for x in found]
                h, g, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])
                    continue
                at = pa.array(np.repeat(np.arange(len(many)), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(g), some.column("doc_id").take(at), some.column("key").take(at),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["h", "g", "doc_id", "key", "first", "last"])

    return _keyed(docs).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, span_words: int = 25) -> DataFrame:
    """(doc_id, key, first, last): all occurrences of repeated spans but the first one of each."""
    # written first, so that both sides of the joins below are plain exchanges, whose hot parts AQE can split
    twice = cut(span_table(docs, span_words, full=False).groupBy("h").count().where("count > 1").select("h"), "twice")
    seen = cut(span_table(docs, span_words).join(twice, "h", "left_semi"), "repeated")
    place = F.struct("doc_id", "key", "first")
    start = cut(seen.groupBy("h", "g").agg(F.min(place).alias("start")), "starts")
    return seen.join(start, ["h", "g"]).where(place != F.col("start")).select("doc_id", "key", "first", "last")


def remove_sentences(text: str | None, covered: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """The text without the sentences in ``covered`` runs, its number of sentences, and of removed ones."""
    if not text:
        return text, 0, 0
    pieces, words, at = split_sentences(text)
    gone = np.zeros(len(words) + 1, np.int64)
    for first, last in covered:
        gone[first] += 1
        gone[last + 1] -= 1
    out = at[np.cumsum(gone)[:-1] > 0].tolist()
    for k in out:
        pieces[k:k + 2] = [""] * len(pieces[k:k + 2])
    return "".join(pieces), len(words), len(out)


def sentence_dedup(docs: DataFrame, span_words: int = 25) -> DataFrame:
    """row (a struct of all input columns, text as it was), text (cleaned), n_sentences and n_removed."""
    runs = repeated_spans(docs, span_words).groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.collect_set(F.struct("first", "last")).alias("covered"))  # at most two a sentence
    docs = docs.withColumn("text", F.col("text").cast("string"))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"))
    keyed = keyed.withColumn("key", F.xxhash64("doc_id", "row.text"))
    joined = keyed.join(runs, (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text")
            done = [remove_sentences(t.as_py(), [(s["first"], s["last"]) for s in c.as_py() or ()])
                    for t, c in zip(texts, batch.column("covered"), strict=True)]
            text, sentences, removed = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(text, pa.string()), pa.array(sentences, pa.int32()),
                 pa.array(removed, pa.int32())], ["row", "text", "n_sentences", "n_removed"])

    kind = keyed.schema["row"].dataType.simpleString()
    return joined.select("row", "covered").mapInArrow(
        rebuild, f"row {kind}, text string, n_sentences int, n_removed int")

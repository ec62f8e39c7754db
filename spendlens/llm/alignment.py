"""Alignment of the tokens of two tokenizers on the same texts, by products of token-byte incidence matrices.

The tokens of a text under tokenizer A are the rows of a sparse 0/1 matrix whose columns are the text's bytes; B likewise.
Both are built by hand as compressed sparse rows, with neighbouring bytes that no token of either side parts as one weighted
column, and a row-by-row (Gustavson) product A x B-transposed has a nonzero
element, the number of shared bytes, for every pair of tokens whose byte ranges overlap: the links.  Byte offsets where
tokens of both end cut the text into groups; the product of the two token-group incidences links the tokens that share a
group, and is returned as the groups themselves (their A and B ids), never as all pairs.

Documents are packed into rows of about ``PACK`` links and written once.  A pack holds its distinct (A id, B id) pairs with
their counts, and of every link only the number of its pair among them, mostly two bytes.  The counts are summed over the
corpus, and each pack meets the counts of its own pairs again.  Within a pack the products run over slices of whole groups,
so a very long text needs memory in proportion to its tokens alone.

Defined results: null and empty texts, and texts whose joined token bytes differ from the text under A or B, have no tokens
and zeros throughout; repeated rows and null ids are rows of their own and all count; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import vocabulary as piece_vocabulary
from .scratch import cut
from .tokens import _byte_alphabet, encoder

PACK = 200_000  # links of a pack, but for a single longer document
CACHE = 200_000  # pieces and units remembered by each tokenizer, half as many as where one works alone
SLICE = 1 << 18  # bytes whose products are formed at a time


class Csr(NamedTuple):
    """A sparse matrix by rows: row i holds ``values`` in the columns ``columns`` from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def incidence(cls, starts: np.ndarray, columns: np.ndarray, width: int) -> Csr:
        return cls(starts, columns, np.ones(len(columns), np.int32), width)

    def rows(self) -> np.ndarray:
        """The row of every stored element."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(self.columns, minlength=self.width)))
        return Csr(starts, self.rows()[order], self.values[order], len(self.starts) - 1)

    def __matmul__(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of the rows of ``other`` that row i names, times its values."""
        lengths = np.diff(other.starts)[self.columns]
        first = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(other.starts[self.columns] - first, lengths)
        key = np.repeat(self.rows(), lengths) * np.int64(other.width) + other.columns[at]
        value = np.repeat(self.values, lengths) * other.values[at]
        if len(key) > 1 and (key[1:] < key[:-1]).any():  # rows met out of order are gathered
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        rows, columns = np.divmod(key[new], other.width)
        starts = np.searchsorted(rows, np.arange(len(self.starts)))
        return Csr(starts, columns, np.add.reduceat(value, new) if len(new) else value, other.width)


def bytes_of(lengths: np.ndarray) -> Csr:
    """Token-byte incidence of consecutive tokens with these lengths."""
    starts = np.append(0, np.cumsum(lengths))
    return Csr.incidence(starts, np.arange(starts[-1]), int(starts[-1]))


def segments_of(a: np.ndarray, b: np.ndarray) -> tuple[Csr, Csr]:
    """Token-byte incidences of two cuttings of the same bytes, with equal neighbouring columns joined into one: the segments
    between ends of any token.  The values of the second are the segments' widths, so that products count bytes as before."""
    ends = np.cumsum(a), np.cumsum(b)
    closes = np.zeros(int(ends[0][-1]) + 1 if len(a) else 1, bool)
    closes[ends[0]] = closes[ends[1]] = True
    closes[0] = False  # tokens without bytes hold no segment
    widths = np.diff(np.flatnonzero(closes), prepend=0).astype(np.int32)
    before, columns = np.cumsum(closes), np.arange(len(widths))
    left, right = (np.append(0, before[e]) for e in ends)
    return Csr.incidence(left, columns, len(widths)), Csr(right, columns, widths, len(widths))


def in_groups(first: np.ndarray) -> Csr:
    """Token-group incidence of consecutive tokens; group g holds the tokens from ``first[g]`` to ``first[g + 1]``."""
    sizes = np.diff(first)
    return Csr.incidence(np.arange(first[-1] + 1), np.repeat(np.arange(len(sizes)), sizes), len(sizes))


def group_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two cuttings of the same bytes, by their tokens' lengths: the offsets where tokens of both end, and the first A and
    first B token of each group, with the numbers of tokens at the end."""
    ends = np.cumsum(a), np.cumsum(b)
    closes = np.zeros(int(ends[0][-1]) + 1 if len(a) else 1, np.int8)
    closes[ends[0]] += 1
    closes[ends[1]] += 1
    common = [closes[e] == 2 for e in ends]
    return ends[0][common[0]], *(np.append(0, np.flatnonzero(c) + 1) for c in common)


def overlap_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of two cuttings of the same bytes, by their lengths: (A number, B number, shared bytes) of every overlap."""
    left, right = segments_of(a, b)
    product = left @ right.transposed()
    return product.rows(), product.columns, product.values


def group_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A number, B number) of all tokens in a common group, for short texts: groups of m and n tokens give m x n."""
    _, a_first, b_first = group_bounds(a, b)
    product = in_groups(a_first) @ in_groups(b_first).transposed()
    return product.rows(), product.columns


def spells(ids: list[np.ndarray], joined: np.ndarray, lengths: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's ids are the text; entry k has ``lengths[k]`` bytes, which follow one another in
    ``joined``.  Bytes are compared for many texts at once, and for some tokens of a long one."""
    starts = np.cumsum(lengths) - lengths
    same = np.array([int(lengths[x].sum()) == len(t) for x, t in zip(ids, texts, strict=True)], bool)
    fit = np.flatnonzero(same)
    if not len(fit):
        return same
    every, given = np.concatenate([ids[k] for k in fit]), np.frombuffer(b"".join([texts[k] for k in fit]), np.uint8)
    text_ends, at = np.cumsum([len(texts[k]) for k in fit]), 0
    for lo in range(0, len(every), SLICE >> 2):
        some = every[lo:lo + (SLICE >> 2)]
        size = lengths[some]
        first = np.cumsum(size) - size
        n = int(size.sum())
        own = joined[np.arange(n) + np.repeat(starts[some] - first, size)]
        same[fit[np.searchsorted(text_ends, at + np.flatnonzero(own != given[at:at + n]), "right")]] = False
        at += n
    return same


class Aligner:
    """Two tokenizers, the bytes of their entries, and the alignment of packs of texts."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = encoder(byte_vocabulary, special=False, cache=CACHE), piece_vocabulary(piece_model, CACHE, own=False)
        with open(byte_vocabulary, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        back = {c: bytes([n]) for n, c in _byte_alphabet().items()}
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.a_bytes[k] = b"".join(back.get(c, c.encode()) for c in entry)
        self.b_bytes = self.b.text_of
        self.a_size, self.b_size = len(self.a_bytes), len(self.b_bytes)
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_joined, self.b_joined = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        #: ids in decimal with the mark that follows: within a side, between A and B, between groups
        self.written = [f"{k}{end}" for size, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for k in range(size)]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The A and B ids of each text, none where either side's bytes are not the text's."""
        none = np.zeros(0, np.int32)
        spaced = [" " + t if t else "" for t in texts]
        whole = [t.encode() for t in spaced]
        a = [np.frombuffer(x, "<u4") for x in self.a.encode(spaced)]
        b = [np.frombuffer(x, "<u4") for x, _ in self.b.encode_all(texts)]
        same = spells(a, self.a_joined, self.a_lengths, whole) & spells(b, self.b_joined, self.b_lengths, whole)
        return [(x.astype(np.int32), y.astype(np.int32)) if s else (none, none) for x, y, s in zip(a, b, same.tolist(), strict=True)]

    def align(self, tokens: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray | list]:
        """Of a pack: per document n_a, n_b, n_groups, n_links, groups_sha256, and all links' ids in order."""
        a, b = (np.concatenate([np.zeros(0, np.int32), *(t[k] for t in tokens)]) for k in (0, 1))
        n_a, n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        group_ends, a_first, b_first = group_bounds(self.a_lengths[a], self.b_lengths[b])  # documents end at common ends
        owner = np.repeat(np.arange(len(tokens)), n_a)  # by A token
        links_a, links_b, per_document = [], [], np.zeros(len(tokens), np.int64)
        lo = 0
        while lo < len(group_ends):
            start = group_ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(group_ends, start + SLICE, "right")))
            own_a, own_b = a[a_first[lo]:a_first[hi]], b[b_first[lo]:b_first[hi]]
            left, right, _ = overlap_links(self.a_lengths[own_a], self.b_lengths[own_b])
            links_a.append(own_a[left])
            links_b.append(own_b[right])
            per_document += np.bincount(owner[a_first[lo] + left], minlength=len(tokens))
            lo = hi
        group_owner = owner[a_first[:-1]] if len(group_ends) else np.zeros(0, np.int64)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(group_owner, minlength=len(tokens)), "n_links": per_document,
                "groups_sha256": self._digests(a, b, a_first, b_first, n_a, n_b),
                "links_a": np.concatenate([np.zeros(0, np.int32), *links_a]), "links_b": np.concatenate([np.zeros(0, np.int32), *links_b])}

    def _digests(self, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, n_a: np.ndarray,
                 n_b: np.ndarray) -> list[str]:
        """sha256 of `a1,a2|b1;a3|b2,b3` per document; of each group the A ids come first."""
        last = [np.zeros(len(x), bool) for x in (a, b)]
        last[0][a_first[1:] - 1] = last[1][b_first[1:] - 1] = True
        codes = np.empty(len(a) + len(b), np.int32)
        codes[np.arange(len(a)) + b_first[in_groups(a_first).columns]] = a + self.a_size * last[0]
        codes[np.arange(len(b)) + a_first[in_groups(b_first).columns + 1]] = 2 * self.a_size + b + self.b_size * last[1]
        code = codes.tolist()
        ends = np.cumsum(n_a + n_b)
        return [sha256("".join(map(self.written.__getitem__, code[e - n:e]))[:-1].encode()).hexdigest() if n else ""
                for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_vocabulary: str, piece_model: str) -> Aligner:
    """The worker's aligner; kept between tasks of one Python worker."""
    key = byte_vocabulary, piece_model
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


_PER_DOCUMENT = ["n_a", "n_b", "n_groups", "n_links"]


def packs(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """Rows of about ``PACK`` links: pack, arrays of one element per document (doc_id, counts, digest), the pack's distinct id
    pairs in ascending order with their numbers of links (arrays pair_a, pair_b, pair_n), and the place of every link's pair
    among them (links: little-endian, ``width`` bytes each) in the documents' order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, base, k = aligner(byte_vocabulary, piece_model), TaskContext.get().partitionId() << 32, 0
        ids, tokens, held = [], [], 0

        def row():
            made = own.align(tokens)
            pairs, links, n = np.unique(made["links_a"].astype(np.int64) << 32 | made["links_b"], return_inverse=True, return_counts=True)
            width = 2 if len(pairs) <= 1 << 16 else 4
            return pa.RecordBatch.from_pydict({
                "pack": pa.array([base + k], pa.int64()), "doc_id": pa.array([ids], pa.list_(pa.int64())),
                **{c: pa.array([made[c]], pa.list_(pa.int64())) for c in _PER_DOCUMENT},
                "groups_sha256": pa.array([made["groups_sha256"]], pa.list_(pa.string())), "width": pa.array([width], pa.int32()),
                **{c: pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for c, x in (
                    ("pair_a", pairs >> 32), ("pair_b", pairs & 0xFFFFFFFF), ("pair_n", n))},
                "links": pa.array([links.astype(f"<u{width}").tobytes()], pa.binary())})

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                for doc_id, pair in zip(some.column(0).to_pylist(), own.tokens(some.column(1).to_pylist()), strict=True):
                    ids.append(doc_id)
                    tokens.append(pair)
                    held += len(pair[0]) + len(pair[1])  # as many links at most
                    if held >= PACK:
                        yield row()
                        ids, tokens, held, k = [], [], 0, k + 1
        if ids:
            yield row()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "pack long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
                                 "n_links array<long>, groups_sha256 array<string>, width int, pair_a array<int>, pair_b array<int>, "
                                 "pair_n array<int>, links binary")


def pack_pairs(packed: DataFrame) -> DataFrame:
    """pack, a, b, n: how many links of the pack hold the id pair linked."""
    named = packed.select("pack", F.col("pair_a").alias("a"), F.col("pair_b").alias("b"), F.col("pair_n").alias("n"))
    return named.select("pack", F.inline(F.arrays_zip("a", "b", "n")))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, links, best: how many links of the corpus hold the pair, and whether that is the most of any pair with its B id."""
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("links")), "pair-counts")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))  # at most one row per entry of B
    return counts.join(F.broadcast(most), "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def _scored(pack: pa.Table, counts: pa.Table) -> pa.Table:
    """The documents of one pack with the corpus counts of its pairs."""
    row = pack.slice(0, 1).to_pylist()[0]
    order = np.argsort(counts["a"].to_numpy().astype(np.int64) << 32 | counts["b"].to_numpy().astype(np.int64))
    at = order[np.frombuffer(row["links"], f"<u{row['width']}")]
    ends = np.cumsum(row["n_links"])
    starts = ends - row["n_links"]
    sums = [np.append(0, np.cumsum(counts[c].to_numpy().astype(np.int64)[at])) for c in ("best", "links")]
    best, total = (s[ends] - s[starts] for s in sums)
    return pa.table({"doc_id": pa.array(row["doc_id"], pa.int64()), **{c: pa.array(row[c], pa.int64()) for c in _PER_DOCUMENT},
                     "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()),
                     "groups_sha256": pa.array(row["groups_sha256"], pa.string())})


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    packed = cut(packs(docs, byte_vocabulary, piece_model), "packs")
    pairs = pack_pairs(packed)
    known = pairs.join(pair_counts(pairs), ["a", "b"]).select(F.col("pack").alias("_pack"), "a", "b", "links",
                                                             F.col("best").cast("int").alias("best"))
    return packed.drop("pair_a", "pair_b", "pair_n").groupBy("pack").cogroup(known.groupBy("_pack")).applyInArrow(
        _scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming radius through BK-trees.

Equal fingerprints are joined first, so copies cost one row.  Two fingerprints that differ in at most ``radius``
bits agree on at least one of ``radius + 1`` blocks of bits, and of the bits outside that block again on one of
``radius + 1`` sub-blocks; each fingerprint therefore goes to (radius + 1)^2 shards, named by the bits that must
agree, and any linked pair meets in one.  A shard still larger than ``shard_rows`` is split the same way on its
remaining bits, until it fits or so few bits remain that it cannot be larger: exact at any skew, and no shard is
unbounded.  Each shard's fingerprints form a BK-tree (children keyed by their Hamming distance to the parent);
a search follows only the edges whose key is within the radius of the distance just measured.  Trees are dealt to
tasks by shard, not broadcast whole, since all trees together grow with the corpus.  A shard gives at most one link per
fingerprint (to the smallest one it reaches there), never all pairs; components are found from these links.

Defined results: null and empty texts have fingerprint 0 and are linked like any other; fewer words than a
shingle: the whole sequence is one; repeated rows are kept and linked; a null doc_id is kept (it is never the
smallest of its component unless all are null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits; each is 1 if set in over half the XXH64 hashes of the text's shingles, repeats included."""
    import xxhash

    words = _WORDS.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    if len(words) < shingle:
        joined = [" ".join(words)]
    else:
        joined = map(" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in joined), np.uint64, max(1, len(words) - shingle + 1))
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        part = hashes[lo:lo + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, key, fp): a hash of doc_id and text, and the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(values.view(np.int64))], ["doc_id", "key", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select("doc_id", _key().alias("key"), "text").mapInArrow(run, "doc_id long, key long, fp long")


def _finer(mask: int, radius: int) -> list[int]:
    """The masks that also fix one of ``radius + 1`` groups of the bits that ``mask`` leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sharded(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Rows (fp, mask) with each mask replaced by its finer ones."""
    finer = F.create_map(*(x for m in masks for x in (
        F.lit(_signed(m)), F.array(*(F.lit(_signed(f)) for f in _finer(m, radius))))))
    return rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))


def bk_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller one of its component in its group) of distinct fingerprints sorted by group,
    found by one BK-tree per group; all trees are built and searched together, level by level."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    root = first[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
    parent, key = np.full(n, -1), np.zeros(n, np.int64)
    todo, at = np.flatnonzero(root != np.arange(n)), root[root != np.arange(n)]
    while len(todo):  # one level of all trees: the first at a distance becomes that child, the others go below it
        d = np.bitwise_count(fp[todo] ^ fp[at]).astype(np.int64)
        edge = at * 65 + d
        _, one, back = np.unique(edge, return_index=True, return_inverse=True)
        child = todo[one]
        parent[child], key[child] = at[one], d[one]
        rest = np.ones(len(todo), bool)
        rest[one] = False
        todo, at = todo[rest], child[back[rest]]
    kids = np.flatnonzero(parent >= 0)
    edges = parent[kids] * 65 + key[kids]
    kids, edges = kids[np.argsort(edges, kind="stable")], np.sort(edges, kind="stable")
    label = np.arange(n)
    # searches run from blocks of fingerprints, so that the frontier stays small in a dense shard too
    alone = np.bincount(root, minlength=n)[root]
    block = np.cumsum(alone) // (1 << 21)
    for lo, hi in zip(*(lambda s: (s, np.r_[s[1:], n]))(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])), strict=True):
        query, node = np.arange(lo, hi), root[lo:hi]
        found_a, found_b = [], []
        while len(query):
            d = np.bitwise_count(fp[query] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < query)
            found_a.append(query[hit])
            found_b.append(node[hit])
            left = np.searchsorted(edges, node * 65 + np.maximum(d - radius, 0), "left")
            right = np.searchsorted(edges, node * 65 + np.minimum(d + radius, 64), "right")
            many = right - left
            query = np.repeat(query, many)
            node = kids[np.repeat(left - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(query))] if len(query) else query
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        while len(a):  # hook larger labels onto smaller ones and flatten
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                flat = label[label]
                if np.array_equal(flat, label):
                    break
                label = flat
    own = label != np.arange(n)
    return fp[own], fp[label[own]]


def hamming_links(fps: DataFrame, radius: int = 3, shard_rows: int = 8192) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose closure joins all pairs within ``radius`` bits."""
    masks, levels = [0], 0
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    done: list[DataFrame] = []
    while True:
        bits = 64 - min(bin(m).count("1") for m in masks)
        last = 1 << bits <= shard_rows or bits <= radius + 1
        if levels < 2 and not last:
            rows, masks, levels = _sharded(rows, masks, radius), [f for m in masks for f in _finer(m, radius)], levels + 1
            continue
        shards = rows.select("mask", F.expr("fp & mask").alias("bits"), "fp")
        sizes = cut(shards.groupBy("mask", "bits").count().where("count > 1"), "shards")
        if last or sizes.where(F.col("count") > shard_rows).isEmpty():
            done.append(shards.join(sizes.select("mask", "bits"), ["mask", "bits"], "left_semi"))
            break
        fit = F.col("count") <= shard_rows
        done.append(shards.join(sizes.where(fit).select("mask", "bits"), ["mask", "bits"], "left_semi"))
        large = shards.join(sizes.where(~fit).select("mask", "bits"), ["mask", "bits"], "left_semi").select("fp", "mask")
        rows = cut(_sharded(large, masks, radius).distinct(), "finer")
        masks, levels = sorted({f for m in masks for f in _finer(m, radius)}), levels + 1
    trees = done[0]
    for more in done[1:]:
        trees = trees.union(more)
    dealt = trees.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(mask, bits, fp):
            group = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
            a, b = bk_links(fp.view(np.uint64), group, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("mask", "bits", "fp")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            mask, bits, _ = now
            if not len(mask):
                continue
            cut_at = int(np.flatnonzero((mask != mask[-1]) | (bits != bits[-1])).max(initial=-1)) + 1
            if cut_at:  # the last shard may go on in the next batch
                yield links(*(x[:cut_at] for x in now))
            held = [x[cut_at:] for x in now]
        if held is not None and len(held[0]):
            yield links(*held)

    return dealt.mapInArrow(search, "a long, b long")


def _rooted(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(fp, root, first): the smallest fingerprint of its component and its own first (doc_id, key)."""
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first"),
                                            F.min("doc_id").alias("doc_id")), "distinct")
    found = components(hamming_links(distinct, radius, shard_rows))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first", "doc_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, shard_rows: int = 8192) -> DataFrame:
    """(doc_id, fingerprint in hexadecimal, component_id): the smallest doc_id that links lead to, itself included."""
    prints = cut(fingerprints(docs, shingle, seed), "fingerprints")
    rooted = cut(_rooted(prints, radius, shard_rows), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = cut(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "named")
    # copies make hot fingerprints: a plain equi-join, whose large partitions AQE splits
    return prints.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, shard_rows: int = 8192) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest doc_id stays, with all its
    columns; of rows that repeat doc_id and text one."""
    rooted = _rooted(cut(fingerprints(docs, shingle, seed), "fingerprints"), radius, shard_rows)
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_d"), F.col("first.key").alias("_k")), "kept")
    names = [f"`{c}`" for c in docs.columns]
    keyed = docs.select(F.struct(*(F.col(c) for c in names)).alias("row")).select(
        "row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"))
    stay = keyed.withColumn("key", _key()).join(
        kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left_semi")
    return stay.dropDuplicates(["doc_id", "key"]).select("row.*")

"""Embedding near-duplicates by cross-polytope hashing.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform and takes the axis it then points
along most, with its sign: nearby vectors share it often, others once in 2d times.  ``hashes`` of them make a bucket code, and
any of ``tables`` independent codes finds a pair.  Longer codes find fewer pairs each, so the number of tables follows from the
codes' length and the vectors': as many as find the share ``recall`` of sampled pairs whose cosine is just ``least``.  Multiprobe: a vector also visits, in each table, the ``probes`` buckets got by
taking the runner-up axis where it comes closest to winning.  Every pair that meets in a bucket is verified by its cosine in
double precision.

Equal vectors are joined first and count with their number.  A pair may meet several times; it is counted only where it
meets first (both carry their codes, so each task decides alone), and buckets return sums and one link per vector, never pairs.
Buckets above ``block_rows`` are dealt out in blocks, each block of owners against each block of members, so that no bucket
is held by one task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and keep their
own id; so do those of another length than their partner; repeated rows are rows of their own, linked to each other; a
null vec_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and is not zero."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0) & (F.size(vector) > 0), F.lit(False))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows turned by rounds of signs and Hadamard transforms (additions only, so that any batch gives the same bits)."""
    n, d = x.shape
    for s in signs:
        x = x * s
        h = 1
        while h < d:
            y = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
            h *= 2
    return x


def codes(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket codes of unit vectors; first each table's own bucket."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.hstack([x, np.zeros((n, width - d))])
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, 1 + probes), np.int64)
    here = np.arange(n)
    for t in range(tables):
        best, runner, lead = [], [], []
        for _ in range(hashes):
            y = rotate(x, rng.choice([-1.0, 1.0], (3, width)))
            size = np.abs(y)
            two = np.argpartition(size, width - 2, axis=1)[:, -2:]
            two = np.take_along_axis(two, np.argsort(np.take_along_axis(size, two, 1), axis=1, kind="stable"), 1)
            a, b = two[:, 1], two[:, 0]
            best.append(2 * a + (y[here, a] < 0))
            runner.append(2 * b + (y[here, b] < 0))
            lead.append((size[here, a] - size[here, b]) / size[here, a])
        place = (2 * width) ** np.arange(hashes)
        own = np.stack(best, 1) @ place
        step = (np.stack(runner, 1) - np.stack(best, 1)) * place
        out[:, t, 0] = own
        # alternatives: sets of hashes that take the runner-up, by the sum of the leads they give up
        sets = np.array([[m >> k & 1 for k in range(hashes)] for m in range(1, 1 << hashes)])
        cost = np.stack(lead, 1) @ sets.T
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:1 + order.shape[1]] = own[:, None] + np.take_along_axis(step @ sets.T, order, 1)
        out[:, t, 1 + order.shape[1]:] = own[:, None]  # fewer alternatives than probes: the own bucket again
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By pair and table, whether one's own bucket is among the other's."""
    return (a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)


def enough_tables(d: int, least: float, tables: int, hashes: int, probes: int, recall: float, seed: int, pairs: int = 4000,
                  most: int = 128) -> int | None:
    """The fewest tables, ``tables`` or more, that find the share ``recall`` of random pairs of cosine ``least``, measured on
    ``pairs`` of them with the very codes the search uses; two standard errors are added.  None if ``most`` are too few."""
    rng = np.random.default_rng(seed + 1)
    turn = math.sqrt(max(0.0, 1 - least * least))
    pairs_of = []
    for lo in range(0, pairs, 500):  # a few pairs at a time: wide vectors stay small
        x, y = rng.normal(size=(2, min(500, pairs - lo), d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        pairs_of.append((x, least * x + turn * y))
    wanted = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / pairs))
    upto = max(tables, 4)
    while True:
        met = np.concatenate([_meet(codes(x, upto, hashes, probes, seed), codes(y, upto, hashes, probes, seed)) for x, y in pairs_of])
        found = np.logical_or.accumulate(met, axis=1).mean(0)
        good = np.flatnonzero(found[tables - 1:] >= wanted)
        if len(good):
            return tables + int(good[0])
        if upto >= most or found[-1] - found[upto // 2 - 1] < 0.001:  # short vectors have few different rotations
            return None
        upto = min(most, 2 * upto)


def sized_index(lengths: list[int], least: float, tables: int, hashes: int, probes: int, recall: float, seed: int) -> tuple[int, int]:
    """(tables, hashes) that reach ``recall`` at every length: the hashes wanted, or fewer where no number of tables is enough."""
    for h in range(hashes, 0, -1):
        needed = [enough_tables(d, least, tables, h, probes, recall, seed) for d in lengths]
        if None not in needed:
            return max([tables, *needed]), h
    raise ValueError(f"cross-polytope codes do not find {recall} of the pairs at cosine {least}")


class _Links:
    """Link counts and local components of one bucket."""

    def __init__(self, n: int):
        self.links, self.label = np.zeros(n, np.int64), np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.label[a], self.label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if len(a):
                np.minimum.at(self.label, np.maximum(la, lb), np.minimum(la, lb))
                while not np.array_equal(flat := self.label[self.label], self.label):
                    self.label = flat


def bucket_links(table: int, code: int, ids: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, many: np.ndarray,
                 sig: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """(id, links, smallest id joined to it here) of a bucket's vectors: owners ``left`` against members ``right``; ids ascend."""
    found = _Links(len(ids))
    own, members = np.flatnonzero(left), np.flatnonzero(right)
    norm = np.sqrt((x * x).sum(1))
    for lo in range(0, len(own), 512):
        rows = own[lo:lo + 512]
        cosine = (x[rows] @ x[members].T) / (norm[rows][:, None] * norm[members])
        i, j = np.nonzero(cosine >= least)
        i, j = rows[i], members[j]
        ours = sig[j, table, 0] == code  # the member owns the bucket too: the pair is met from its smaller side
        keep = (i != j) & (~ours | (ids[i] < ids[j]))
        i, j, ours = i[keep], j[keep], ours[keep]
        found.join(i, j)
        for at in range(0, len(i), 1 << 16):
            p, q, both = i[at:at + (1 << 16)], j[at:at + (1 << 16)], ours[at:at + (1 << 16)]
            earlier = _meet(sig[p, :table], sig[q, :table]).any(1) if table else np.zeros(len(p), bool)
            # a visitor whose own bucket the owner visits as well meets it there too: counted where the owner's id is smaller
            mutual = ~both & (sig[q, table, :1] == sig[p, table]).any(1) & (ids[q] < ids[p])
            new = ~earlier & ~mutual
            np.add.at(found.links, p[new], many[q[new]])
            np.add.at(found.links, q[new], many[p[new]])
    some = (found.links > 0) | (found.label != np.arange(len(ids)))
    return ids[some], found.links[some], ids[found.label[some]]


def class_links(classes: DataFrame, least: float, tables: int, hashes: int, probes: int, block_rows: int, seed: int) -> DataFrame:
    """(id, links, other): partial link counts of classes (id, vector: array<double>, many) and links to smaller classes."""
    width = 1 + probes

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            sig = np.zeros((batch.num_rows, tables, width), np.int64)
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                x = flat[vectors.offsets.to_numpy()[own][:, None] - vectors.offsets[0].as_py() + np.arange(d)]
                x = x / np.abs(x).max(1, keepdims=True)
                sig[own] = codes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, hashes, probes, seed)
            yield batch.append_column("sig", pa.FixedSizeListArray.from_arrays(sig.reshape(-1), tables * width).cast(
                pa.list_(pa.int64())))

    kinds = ", ".join(f"{c} {k}" for c, k in classes.dtypes)
    signed = cut(classes.mapInArrow(hashed, f"{kinds}, sig array<bigint>"), "signatures")
    visits = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(tables * width - 1)), lambda k: F.struct(
        F.floor(k / width).cast("int").alias("table"), F.get(F.col("sig"), k).alias("code"),
        (F.get(F.col("sig"), k) == F.get(F.col("sig"), (F.floor(k / width) * width).cast("int"))).alias("own"))))
    rows = signed.select("id", "vector", "many", "sig", F.size("vector").alias("d"), F.explode(visits).alias("v")).select(
        "id", "vector", "many", "sig", "d", "v.*")
    bucket = ["table", "d", "code"]
    large = cut(rows.groupBy(*bucket).count().where(F.col("count") > block_rows).select(
        *(F.col(c).alias(f"_{c}") for c in bucket), F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "buckets")
    same = F.col("table") == F.col("_table")
    for c in bucket[1:]:
        same &= F.col(c) == F.col(f"_{c}")
    rows = rows.join(large, same, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    none = F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")
    as_left = F.transform(every, lambda j: F.struct(mine.alias("i"), j.alias("j"), F.lit(True).alias("left"), (j == mine).alias("right")))
    as_right = F.transform(every, lambda i: F.struct(i.alias("i"), mine.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    places = F.concat(F.when(F.col("own"), as_left).otherwise(none),
                      F.when(F.col("own"), F.filter(as_right, lambda s: s["i"] != mine)).otherwise(as_right))
    key = [*bucket, "i", "j"]
    dealt = rows.select("id", "vector", "many", "sig", *bucket, F.explode(places).alias("p")).select(
        "id", "vector", "many", "sig", *bucket, "p.*").repartition(*key).sortWithinPartitions(*key, "id")

    def verify(table: pa.Table) -> pa.RecordBatch:
        t, code, d = table["table"][0].as_py(), table["code"][0].as_py(), table["d"][0].as_py()
        n = table.num_rows
        x = np.asarray(table["vector"].combine_chunks().flatten()).reshape(n, d)
        sig = np.asarray(table["sig"].combine_chunks().flatten()).reshape(n, tables, width)
        got = bucket_links(t, code, *(np.asarray(table[c]) for c in ("id", "left", "right")), x, np.asarray(table["many"]), sig, least)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in got], ["id", "links", "other"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in key], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if batch.num_rows else []
            for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if at is not None and tuple(keys[lo]) != at and held:
                    if sum(b.num_rows for b in held) > 1:
                        yield verify(pa.Table.from_batches(held))
                    held = []
                at = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held and sum(b.num_rows for b in held) > 1:
            yield verify(pa.Table.from_batches(held))

    return dealt.mapInArrow(search, "id long, links long, other long")


def near_duplicates(vectors: DataFrame, least: float = 0.95, tables: int = 4, probes: int = 2, bucket_rows: int = 64,
                    block_rows: int = 4096, seed: int = 0, recall: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    ``bucket_rows`` sizes the index: as many hashes make a code as bring unrelated vectors down to that many a bucket.
    ``tables`` is the least number of tables; there are more where the codes need them to find ``recall`` of the pairs at
    ``least``, and shorter codes where no number of tables does.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(usable(F.col("vector")), F.col("vector")))
    classes = cut(rows.where(F.col("vector").isNotNull()).groupBy("vector").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("many")).withColumn("id", F.monotonically_increasing_id()), "classes")
    about = classes.groupBy(F.ceil(F.log2(F.size("vector"))).alias("bits")).agg(  # one row per power of two
        F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).collect()
    lengths = [r["d"] for r in about]
    axes = 2 << max(1, (max(lengths, default=2) - 1).bit_length())
    hashes = max(2, math.ceil(math.log(max(2, sum(r["n"] for r in about)) / bucket_rows, axes)))
    tables, hashes = sized_index(lengths, least, tables, hashes, probes, recall, seed)
    links = cut(class_links(classes.select("id", "vector", "many"), least, tables, hashes, probes, block_rows, seed), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    found = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.join(counts, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "vector", "vec_id", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "id").alias("root"))
    smallest = known.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = cut(known.join(smallest, "root").select(F.col("vector").alias("_v"), "n_links", "component_id"), "classes-found")
    joined = rows.join(known, F.col("vector") == F.col("_v"), "left")
    component = F.when(F.col("_v").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                         component.eqNullSafe(F.col("vec_id")).alias("kept"))

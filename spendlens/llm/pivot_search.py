"""Exact top-k search by integer inner product through a pivot-distance index.

With one more component that makes all vectors equally long, the largest inner product is the smallest distance.  Pivots are
spread over a bounded sample; every vector is keyed by its nearest pivot and its distance to it, and each pivot's
vectors are cut by distance into sorted annuli (bounds from the same sample; every row is indexed).  By the triangle
inequality a query's distance to anything in an annulus is at least its own distance to the pivot less the outer radius, or
the inner radius less that distance.  A query reads annuli in the order of these bounds, a few at first and then ever more,
and stops when no unread annulus can hold a score as good as its k-th.  Scores are exact integers; ties go to the smaller id.

Queries travel in packs to the annuli they still need, annuli above ``split_rows`` are dealt out in parts, and what comes back is
at most k rows per query and part: nothing grows with the square of a group.

Vectors of different lengths have no product: each length has an index of its own.

Defined results: vectors that are null or hold null or non-finite components, rows without an id, and vectors whose scaled
squares add up to 2**61 or more, whose scores might pass a LONG, take no part; a query does not find rows with its own id; an id that is
queried twice is searched with its smaller vector; equal rows are candidates each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


_NONE = -(1 << 62)  # below any score; its negative is still a number


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component; null if the vector or a component is null or not finite, or its squares too
    large: two vectors with squares below 2**62 have a product below it as well."""
    x = vector.cast("array<double>")
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v * float(factor) ** 2)
    fine = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & (squares < 2.0**61)
    return F.when(fine, F.transform(x, lambda v: F.floor(v * float(factor)).cast("long")))


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d).astype(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; by floating point where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0**52:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Index:
    """Pivots, radii of annuli, and what each annulus holds: all bounded by ``pivots`` x ``annuli``."""

    def __init__(self, sample: np.ndarray, longest: int, pivots: int, annuli: int):
        self.longest = longest
        full = self.lift(sample)
        chosen, far = [0], np.full(len(full), np.inf)
        while len(chosen) < min(pivots, len(full)):  # farthest first
            far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(1))
            chosen.append(int(far.argmax()))
        self.pivots = full[chosen]
        own, radius = self.place(sample)
        share = np.linspace(0, 1, annuli + 1)[1:-1]
        self.bounds = np.array([np.quantile(radius[own == p], share) if (own == p).any() else np.zeros(len(share))
                                for p in range(len(chosen))]).reshape(len(chosen), len(share))
        self.annuli = annuli

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest - (x * x).sum(1), 0)
        return np.hstack([x.astype(float), np.sqrt(rest.astype(float))[:, None]])

    def distances(self, full: np.ndarray) -> np.ndarray:
        square = (full * full).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(self.lift(x))
        own = d.argmin(1)
        return own, d[np.arange(len(x)), own]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, radius = self.place(x)
        ring = (self.bounds[own] <= radius[:, None]).sum(1)
        return own * self.annuli + ring, radius

    def fill(self, directory: list) -> None:
        """Cells that hold anything, with inner and outer radius."""
        self.cell = np.array([r["cell"] for r in directory], np.int64)
        self.inner = np.array([r["inner"] for r in directory], float)
        self.outer = np.array([r["outer"] for r in directory], float)
        self.parts = np.array([r["parts"] for r in directory], np.int64)

    def best(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each cell can hold for each query (a little more, for rounding)."""
        flat = np.hstack([q.astype(float), np.zeros((len(q), 1))])
        d = self.distances(flat)[:, self.cell // self.annuli]
        gap = np.maximum(np.maximum(d - self.outer, self.inner - d), 0) * (1 - 1e-9)
        gap = np.maximum(gap - 1e-3, 0)
        return ((q * q).sum(1).astype(float)[:, None] + self.longest - gap * gap) / 2 + 1


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, factor: int = 256, pivots: int = 32, annuli: int = 8,
          sample_rows: int = 4096, split_rows: int = 65_536, first: int = 4, growth: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for every query among (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), factor).alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0")
    result = "query_id long, rank int, vec_id long, score long"
    lengths = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # one, as a rule
    found = [_top_k(rows.where(F.size("v") == d), d, is_query, k, pivots, annuli, sample_rows, split_rows, first, growth) for d in lengths]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], result)


def _top_k(rows: DataFrame, d: int, is_query: Callable[[Column], Column], k: int, pivots: int, annuli: int, sample_rows: int,
           split_rows: int, first: int, growth: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).collect()  # bounded by sample_rows
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()[0]
    index = Index(np.array([r["v"] for r in drawn], np.int64), longest, pivots, annuli)

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, radius = index.cells(_matrix(batch.column("v"), d))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(radius), *batch.columns], ["cell", "radius", "vec_id", "v"])

    keyed = cut(rows.mapInArrow(key, "cell long, radius double, vec_id long, v array<bigint>"), "pivot-index")
    index.fill(keyed.groupBy("cell").agg(F.min("radius").alias("inner"), F.max("radius").alias("outer"),
                                         F.ceil(F.count("*") / split_rows).cast("int").alias("parts"))
               .orderBy("cell").collect())  # at most pivots x annuli rows
    parts = dict(zip(index.cell.tolist(), index.parts.tolist(), strict=True))
    split = F.coalesce(F.get(F.lit([parts.get(c, 1) for c in range(len(index.pivots) * annuli)]), F.col("cell").cast("int")), F.lit(1))
    chunks = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), split).cast("int"))

    def order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's turn of every annulus, fixed once: rounds must not visit one twice or never."""
        for batch in batches:
            bound = index.best(_matrix(batch.column("q"), d))
            turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1).astype("<u4")
            yield batch.append_column("turns", pa.array([t.tobytes() for t in turn], pa.binary()))

    queries = rows.where(is_query(F.col("vec_id"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    state = cut(queries.mapInArrow(order, "query_id long, q array<bigint>, turns binary").withColumn(
        "top", F.array().cast("array<struct<score:bigint,vec_id:bigint>>")), "queries")
    low, high, cells = 0, first, len(index.cell)
    while True:
        state = cut(_round(state, chunks, index, d, k, low, high), "searched")
        if high >= cells:
            break
        low, high = high, high * growth
    best = F.posexplode("top").alias("pos", "hit")
    return state.select("query_id", best).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                                                 F.col("hit.score").alias("score"))


def _round(state: DataFrame, chunks: DataFrame, index: Index, d: int, k: int, low: int, high: int) -> DataFrame:
    """Every query's best rows after its annuli number ``low`` to ``high`` in the order of their bounds."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, ids = _matrix(batch.column("q"), d), batch.column("query_id").to_numpy()
            kth = np.array([t[k - 1]["score"] if len(t) >= k else _NONE for t in batch.column("top").to_pylist()])
            bound = index.best(q)
            turn = np.frombuffer(b"".join(batch.column("turns").to_pylist()), "<u4").reshape(bound.shape)
            need = (turn >= low) & (turn < high) & (bound >= kth[:, None])
            for c in np.flatnonzero(need.any(0)).tolist():
                own = need[:, c]
                n = int(index.parts[c])
                packed = [ids[own].astype("<i8").tobytes(), q[own].astype("<i8").tobytes(), kth[own].astype("<i8").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(index.cell[c])] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     *(pa.array([p] * n, pa.binary()) for p in packed)], ["cell", "part", "ids", "q", "kth"])

    packs = state.mapInArrow(pack, "cell long, part int, ids binary, q binary, kth binary").withColumn("is_pack", F.lit(True))
    none = F.lit(None)
    both = packs.select("cell", "part", "is_pack", "ids", "q", "kth", none.cast("long").alias("vec_id"),
                        none.cast("array<bigint>").alias("v")).union(
        chunks.select("cell", "part", F.lit(False), none.cast("binary"), none.cast("binary"), none.cast("binary"), "vec_id", "v"))
    dealt = both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("is_pack").desc())

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packs = None, []
        for batch in batches:
            keys = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist(), strict=True))
            is_pack = batch.column("is_pack").to_numpy(zero_copy_only=False)
            edge = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1] or is_pack[k] != is_pack[k - 1]]
            for lo, hi in zip(edge, [*edge[1:], len(keys)], strict=True):
                if keys[lo] != at:
                    at, packs = keys[lo], []
                some = batch.slice(lo, hi - lo)
                if is_pack[lo]:
                    packs += list(zip(*(some.column(c).to_pylist() for c in ("ids", "q", "kth")), strict=True))
                    continue
                ids, x = some.column("vec_id").to_numpy(), _matrix(some.column("v"), d)
                for p in packs:
                    yield from _best_of(*(np.frombuffer(b, "<i8") for b in p), ids, x, d, k)

    hits = dealt.mapInArrow(search, "query_id long, score long, vec_id long")
    known = state.select("query_id", F.explode("top").alias("t")).select("query_id", "t.score", "t.vec_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = known.union(hits).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    merged = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "score", "vec_id"))).alias("t"))
    top = F.transform("t", lambda s: F.struct(s["score"].alias("score"), s["vec_id"].alias("vec_id")))
    return state.drop("top").join(merged.select("query_id", top.alias("top")), "query_id", "left").withColumn(
        "top", F.coalesce("top", F.array().cast("array<struct<score:bigint,vec_id:bigint>>")))


def _best_of(queries: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, d: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each query's k best of some rows, by score and then id, that its k-th so far does not beat."""
    q = q.reshape(-1, d)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    none = _NONE
    for lo in range(0, len(q), 256):
        score = products(q[lo:lo + 256], x)
        score[queries[lo:lo + 256][:, None] == ids] = none
        best = np.argsort(-score, axis=1, kind="stable")[:, :k] if len(ids) <= 64 else _largest(score, k)
        got = np.take_along_axis(score, best, 1)
        i, j = np.nonzero((got != none) & (got >= kth[lo:lo + 256][:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(queries[lo:lo + 256][i]), pa.array(got[i, j]), pa.array(ids[best[i, j]])],
                                         ["query_id", "score", "vec_id"])


def _largest(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row; among equals the first columns."""
    n = score.shape[1]
    least = np.partition(score, n - k, axis=1)[:, n - k][:, None]
    # what is above the k-th value comes first, then its equals from the left
    rank = np.where(score > least, 0, np.where(score == least, 1, 2)).astype(np.int8)
    out = np.argsort(rank, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(out, np.argsort(-np.take_along_axis(score, out, 1), axis=1, kind="stable"), 1)

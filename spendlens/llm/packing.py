"""Best-two-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Method: a sequence is filled greedily with the longest pieces that still fit; then its smallest piece is
replaced by two unpacked ones if together they fill the widened gap more tightly.  Which pieces are taken
depends only on their lengths, so the plan is drawn up on the histogram of lengths (at most ``capacity``
rows, whatever the size of the corpus): equal sequences are planned once with a repeat count, and every
piece finds its place from its rank among the pieces of its length.  Ranks come from per-task counts and
running offsets, so no length, however common, meets in one task.

Defined results: a null text is empty and gets the end id alone; a document longer than ``capacity`` is cut
into full pieces with the shorter remainder first; repeated rows are packed as often as they occur; a null
``doc_id`` is kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .tokens import encoder

Pattern = tuple[tuple[int, ...], int]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and (``part``, ``rank``), its number among
    the pieces of its length in its task; with ``keep_ids`` also the ids (little-endian uint32)."""
    end = int(end_id).to_bytes(4, "little")
    schema = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long"
    names = [f.split()[0] for f in schema.split(", ")] + ["ids"] * keep_ids

    def cut_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, encode = TaskContext.get().partitionId(), [0] * (capacity + 1), encoder(vocabulary).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some, out = batch.slice(lo, 500), []
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        length = (n - at) % capacity or capacity if n > capacity else n
                        own = ids[4 * at:4 * (at + length)]
                        out.append((part, doc_id, k, at, length, zlib.crc32(own), seen[length]) + (own,) * keep_ids)
                        seen[length] += 1
                        at, k = at + length, k + 1
                types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(cut_up, schema + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Sequences as (lengths in order, how many such), for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    out: list[Pattern] = []
    while order:
        used: Counter[int] = Counter()
        gap = capacity
        while gap:  # greedy: the longest unpacked piece that fits
            k = bisect_right(order, gap)
            while k and used[order[k - 1]] >= left[order[k - 1]]:
                k -= 1
            if not k:
                break
            used[order[k - 1]] += 1
            gap -= order[k - 1]
        if gap and len(order) > 1:
            small = min(used)
            free = np.array([n for n in order if left[n] > used[n] and n < gap + small])
            pair = _best_two(free, gap + small, lambda n: left[n] - used[n] >= 2)
            if pair and sum(pair) > small:
                used[small] -= 1
                used.update(pair)
                used += Counter()
        times = min(left[n] // m for n, m in used.items())
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
        for n, m in used.items():
            left[n] -= m * times
            if not left[n]:
                order.remove(n)
                del left[n]
    return out


def _best_two(free: np.ndarray, room: int, twice) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum of at most ``room``."""
    best = None
    if len(free):
        k = np.searchsorted(free, room - free, "right") - 1  # the longest partner of each
        for a, j in zip(free[k >= 0].tolist(), k[k >= 0].tolist(), strict=True):
            if free[j] == a and not twice(a):
                j -= 1
            if j >= 0 and (best is None or a + free[j] > sum(best)):
                best = (a, int(free[j]))
                if sum(best) == room:
                    break
    return best


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks of its runs, and of each run the first sequence, slots in a sequence, offsets."""
    runs: dict[int, list[tuple]] = {}
    ranks: Counter[int] = Counter()
    base = 0
    for lengths, times in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, slots in offsets.items():
            runs.setdefault(n, []).append((ranks[n], base, slots))
            ranks[n] += len(slots) * times
        base += times
    return {n: (np.array([r[0] for r in x]), np.array([r[1] for r in x]), [np.array(r[2]) for r in x])
            for n, x in runs.items()}


def pack_pieces(parts: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (see ``pieces``)."""
    totals = cut(parts.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    places = _places(plan(counts, capacity))
    before = totals.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = parts.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = [c for c in parts.columns if c not in ("part", "rank")]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, base, slots = places[n]
                run = np.searchsorted(first, rank[own], "right") - 1
                for k in np.unique(run).tolist():
                    at = own[run == k]
                    nth, slot = np.divmod(rank[at] - first[k], len(slots[k]))
                    sequence[at], offset[at] = base[k] + nth, slots[k][slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                                             [*columns, "sequence_id", "offset"])

    kinds = dict(parts.dtypes)
    return ranked.select(*columns, "rank").mapInArrow(
        place, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def best_two_fit(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2,
                 keep_ids: bool = False) -> DataFrame:
    """Placements of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    return pack_pieces(cut(pieces(docs, vocabulary, capacity, end_id, keep_ids), "pieces"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed token sequences of placements made with ``keep_ids``: sequence_id, length, ids."""
    one = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``capacity`` ids
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.reduce(
        one, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

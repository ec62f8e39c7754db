"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

Each id is predicted by three models that learn as they go: order 0 (frequencies of all ids of the block so
far), order 1 and order 2 (the id last seen after the last one or two ids, with a confidence).  The mixture
P(id) = w2 [id = c2] + w1 [id = c1] + w0 P0(id) takes its weights from counts kept for every joint state of
the two confidences, so they follow how far each order has been right.  The mixture drives a 48-bit range
coder with carries.  A block is cut into ``LANES`` runs of consecutive ids which share the models but have a
coder of their own, so that one NumPy step codes one id of every run.  All arithmetic is on integers: any
machine decodes what any other has written.

A file is a Parquet table with one block a row: (part, block, first, n_tokens, payload), where ``first``
counts the part's ids before the block.  Parts are ranges of ascending doc_id; a payload holds its documents'
ids and lengths, the coded ids and a CRC-32 of all, checked on reading.  A block holds whole documents and is
closed at ``BLOCK`` ids, so its size is bounded by that and the longest document.

Defined results: a null text is empty (the end id alone); a null doc_id comes first and is kept; ties of
doc_id are ordered by a hash of the text and all kept; an empty table gives an empty file; other columns of the
input are ignored; a damaged block raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import encoder

BLOCK, LANES = 1 << 20, 4096
SOME = 4_000_000  # bytes of text tokenised at a time, at least one text
_MAGIC = b"CMRC\x01"
_W, _C0 = 12, 18  # bits of the mixture's weights and of order-0 frequencies: intervals are in units of 2**-30
_LOW, _MASK = 1 << 32, (1 << 32) - 1
_LIMIT = 1 << 14  # weight counts are halved beyond this
#: Change of a confidence, first of 0 to 7 when wrong (half as sure; the new id if there was little), then when right (a step surer).
_SURER = np.array([(t >> 1) - t for t in range(8)] + [int(t < 7) for t in range(8)], np.int32)


class _Models:
    """What both sides know of the block so far."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size, np.int64)
        self.recent: list[np.ndarray] = []
        self.step = 0
        self.known = [np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)]  # last id << 3 | confidence
        self.weight = np.ones((128, 3), np.int64) * np.array([1, 1, 4])
        self.learn()
        self.weigh()

    def learn(self) -> None:
        """Order-0 frequencies anew from all ids seen; they sum to 2**_C0."""
        if self.recent:
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.size)
            self.recent = []
        total = max(1, int(self.count.sum()))
        freq = 1 + self.count * ((1 << _C0) - self.size) // total
        freq[int(self.count.argmax())] += (1 << _C0) - int(freq.sum())
        self.freq = freq
        self.start = np.cumsum(freq) - freq

    def weigh(self) -> None:
        """The mixture's shares of order 2, order 1 and order 0 by state, in 2**-_W."""
        shares, total = (1 << _W) - 128, self.weight.sum(1)
        self.w2, self.w1 = self.weight[:, 0] * shares // total + 1, self.weight[:, 1] * shares // total + 1
        self.w0 = (1 << _W) - self.w2 - self.w1

    def predict(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """The guesses of order 2 and 1, and the shares of order 2, order 1 and order 0."""
        self.slot = [(last * 40503) & 0xFFFF, (last * 0x9E3779B1 + before * 0x85EBCA6B >> 7) & 0x3FFFF]
        self.was = [k.take(s) for k, s in zip(self.known, self.slot, strict=True)]
        c1, c2 = self.was[0] >> 3, self.was[1] >> 3
        self.trust = [self.was[0] & 7, self.was[1] & 7]
        self.state = (self.trust[1] << 4) + (self.trust[0] << 1) + (c1 == c2)
        return c2, c1, self.w2.take(self.state), self.w1.take(self.state), self.w0.take(self.state)

    def update(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray, kind: np.ndarray) -> None:
        fresh = ((ids << 3) + 1).astype(np.int32)
        for k, right in ((0, right1), (1, right2)):
            trust = self.trust[k]
            self.known[k][self.slot[k]] = np.where((trust <= 1) & ~right, fresh, self.was[k] + _SURER.take(trust + 8 * right))
        self.recent.append(ids)
        self.step += 1
        if self.step % 4 == 0:  # the weights follow every fourth step
            self.weight += 96 * np.bincount(self.state * 3 + kind, minlength=384).reshape(128, 3)
            while (over := self.weight.sum(1) > _LIMIT).any():
                self.weight[over] = (self.weight[over] >> 1) + 1
            self.weigh()
        if self.step % 32 == 0 or self.step & (self.step - 1) == 0:
            self.learn()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def encode_ids(ids: np.ndarray, size: int) -> bytes:
    """One block's ids (each below ``size``): the runs' lengths in words, then their words."""
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = _Models(size)
    low, width = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1, np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    words, given = np.zeros((2 * steps + 1, lanes), np.int32), np.zeros((2 * steps + 1, lanes), bool)
    for t in range(steps):
        live = -(-(n - t) // steps)
        if live < len(last):
            last, before = last[:live], before[:live]
        x = grid[t, :live]
        c2, c1, w2, w1, w0 = model.predict(last, before)
        right2, right1 = x == c2, x == c1
        second = right1 & ~right2
        miss = ~(right2 | right1)
        kind = miss * 2 + second
        start = miss * ((w2 + w1 << _C0) + model.start.take(x) * w0) + second * (w2 << _C0)
        freq = miss * (model.freq.take(x) * w0) + (second * w1 + right2 * w2 << _C0)
        unit = width[:live] >> _W + _C0
        low[:live] += unit * start
        width[:live] = unit * freq
        for r in (2 * t, 2 * t + 1):  # an interval of 2**-30 at the narrowest gives two words at most
            need = width < _LOW
            if r & 1 and not need.any():
                break
            top = low >> 32
            words[r], given[r] = top, need
            low = low - (top * need << 32) << need * 16
            width <<= need * 16
        model.update(x, right2, right1, kind)
        last, before = x, last
    words[-1], given[-1] = low + _MASK >> 32, True
    held = np.ascontiguousarray(given.T)
    out = np.ascontiguousarray(words.T)[held].astype(np.int64)
    while (carry := out >> 16).any():  # carries run towards the front, never past a run's first word
        out &= 0xFFFF
        out[:-1] += carry[1:]
    return held.sum(1).astype("<u4").tobytes() + out.astype("<u2").tobytes()


def decode_ids(data: bytes, n: int, size: int) -> np.ndarray:
    lanes, steps = _shape(n)
    length = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    # four words of padding behind every run, so that reading past its end gives zeros
    edge = np.cumsum(length + 4) - (length + 4)
    flat = np.zeros(int((length + 4).sum()), np.int64)
    flat[np.arange(int(length.sum())) + np.repeat(4 * np.arange(lanes), length)] = np.frombuffer(data, "<u2", offset=4 * lanes)
    code, at = (flat[edge] << 32) + (flat[edge + 1] << 16) + flat[edge + 2], edge + 3
    model = _Models(size)
    width = np.full(lanes, (1 << 48) - 1, np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    grid = np.zeros((steps, lanes), np.int64)
    owner, freq_of = None, None
    for t in range(steps):
        live = -(-(n - t) // steps)
        if live < len(last):
            last, before, code, width, at = last[:live], before[:live], code[:live], width[:live], at[:live]
        c2, c1, w2, w1, w0 = model.predict(last, before)
        if freq_of is not model.freq:  # the id that owns each unit of order 0
            owner, freq_of = np.repeat(np.arange(size, dtype=np.int32), model.freq), model.freq
        unit = width >> _W + _C0
        # quotients of whole numbers below 2**48 by ones below 2**18 are never rounded up to the next whole number
        value = np.minimum((code / unit).astype(np.int64), (1 << _W + _C0) - 1)
        share = value >> _C0
        miss = share >= w2 + w1
        second = (share >= w2) & ~miss
        kind = miss * 2 + second
        x = np.where(second, c1, c2).astype(np.int64)
        out = np.flatnonzero(miss)
        x[out] = owner.take(((value - (w2 + w1 << _C0)).take(out) / w0.take(out)).astype(np.int64))
        right2 = x == c2
        start = miss * ((w2 + w1 << _C0) + model.start.take(x) * w0) + second * (w2 << _C0)
        freq = miss * (model.freq.take(x) * w0) + (second * w1 + (kind == 0) * w2 << _C0)
        code = code - unit * start
        width = unit * freq
        for _ in range(2):
            need = width < _LOW
            if not need.any():
                break
            shift = need * 16
            code = (code << shift) + flat[at] * need
            width = width << shift
            at = at + need
        grid[t, :live] = x
        model.update(x, right2, x == c1, kind)
        last, before = x, last
    return grid.T.reshape(-1)[:n]


def write_block(doc_ids: list[int | None], ids: list[bytes], size: int) -> bytes:
    """A block of whole documents; ``ids`` are little-endian uint32."""
    joined = b"".join(ids)
    values = np.frombuffer(joined, "<u4")
    if len(values) and int(values.max()) >= size:
        raise ValueError(f"id {int(values.max())} is not below the vocabulary size {size}")
    about = (np.array([d is None for d in doc_ids], "u1").tobytes()
             + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([len(b) // 4 for b in ids], "<i8").tobytes())
    meta = zlib.compress(about, 6)
    coded = encode_ids(values, size) if len(values) else b""
    head = struct.pack("<5sIIIII", _MAGIC, size, len(doc_ids), len(values), len(meta), zlib.crc32(joined, zlib.crc32(about)))
    return head + meta + coded


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, all ids as uint32) of a block."""
    magic, size, docs, n, held, crc = struct.unpack_from("<5sIIIII", payload)
    if magic != _MAGIC:
        raise ValueError("not a block of token ids")
    at = struct.calcsize("<5sIIIII")
    about = zlib.decompress(payload[at:at + held])
    try:
        ids = decode_ids(payload[at + held:], n, size).astype("<u4") if n else np.zeros(0, "<u4")
    except (IndexError, ValueError) as e:  # damage may lead the decoder past the block's end
        raise ValueError("damaged block of token ids") from e
    if zlib.crc32(ids, zlib.crc32(about)) != crc:
        raise ValueError("checksum of a block of token ids does not match")
    null = np.frombuffer(about, "u1", docs)
    doc_ids = np.frombuffer(about, "<i8", docs, docs).tolist()
    return ([None if z else d for d, z in zip(doc_ids, null, strict=True)],
            np.frombuffer(about, "<i8", docs, 9 * docs), ids)


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 50_257) -> DataFrame:
    """The file's rows: documents in ascending doc_id order, tokenised, each followed by ``end_id``."""
    end = int(end_id).to_bytes(4, "little")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        ids, names, held, block, first = [], [], 0, 0, 0

        def row():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "first": pa.array([first], pa.int64()), "n_tokens": pa.array([held], pa.int64()),
                "payload": pa.array([write_block(names, ids, size)], pa.binary())})

        for batch in batches:
            rows = max(1, min(2000, SOME * batch.num_rows // max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, rows):
                some = batch.slice(lo, rows)
                for doc_id, own in zip(some.column(0).to_pylist(), encode(some.column(1).to_pylist()), strict=True):
                    ids.append(own + end)
                    names.append(doc_id)
                    held += len(own) // 4 + 1
                    if held >= BLOCK:
                        yield row()
                        ids, names, held, block, first = [], [], 0, block + 1, first + held
        if names:
            yield row()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return (plain.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(blocks, "part int, block int, first long, n_tokens long, payload binary"))


def decode_documents(blocks: DataFrame, keep_ids: bool = False) -> DataFrame:
    """What a file holds: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, uint32)."""
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row a part
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = read_block(payload.as_py())
                end = np.cumsum(lengths)
                own = [ids[e - n:e].tobytes() for e, n in zip(end.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(first + end - lengths, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array([zlib.crc32(b) for b in own], pa.int64())]
                    + [pa.array(own, pa.binary())] * keep_ids, names)

    placed = blocks.join(F.broadcast(before), "part")  # as many rows as the file has parts
    return placed.select((F.col("first") + F.col("base")).alias("first"), "payload").mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)

"""Encoding and decoding with a SentencePiece vocabulary of the merge type, by an agenda of adjacent symbol pairs.

A text gets a word mark (U+2581) in front and for every blank.  Its characters are the first symbols; every adjacent pair
whose joined form is in the vocabulary waits in an agenda ordered by score, then by place from the left; the best pair is
joined and the pairs it makes with its neighbours are added, until the agenda is empty.  Symbols that are no entry are
spelled in byte entries, or become the unknown id where the vocabulary has none.

No entry spans a place before a word mark that follows another character, nor one beside a line feed where no longer entry
holds one, so joins on the two sides never meet: a text is cut there into units, each is worked out once per worker and
remembered (about ``CACHE_UNITS`` of those met last).  In every Arrow batch the units not met before
are also given to the library in one call and compared; ``agrees`` tells whether all of a text's units did.

Defined results: a null text is empty, and an empty text has no ids and decodes to the empty text; texts of any length are
processed whole; a word mark in a text counts as a blank, as in the library; repeated rows and null ids are kept; an empty
table gives an empty result; columns not asked for are ignored, whatever their names.  Vocabularies of another type, or
with normalisation rules of their own, raise ValueError.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_UNITS = 400_000
ROW_LENGTH = 32  # units of up to so many characters are worked out many at a time
MARK = "▁"


class Vocabulary:
    """The entries of a model file, its agenda and its decoder."""

    def __init__(self, path: str, cache: int = 0, own: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE:
            raise ValueError(f"{path} is no vocabulary of the merge type")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError(f"{path} has normalisation rules of its own")
        kinds = type(model.pieces[0])
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError(f"{path} has entries that users defined")
        self.cache = cache  # units to remember, CACHE_UNITS by default
        self.own = own  # whether units are worked out here and compared; otherwise the library's ids are taken
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = len(model.pieces)
        self.id_of = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.control = {k for k, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown_text = model.trainer_spec.unk_surface.encode()
        self.byte_of = {k: bytes([b]) for b, k in self.byte_ids.items()}
        #: what each id decodes to; control entries to nothing
        self.text_of = [b"" if k in self.control else self.unknown_text if k == self.unknown else self.byte_of.get(k)
                        or p.piece.replace(MARK, " ").encode() for k, p in enumerate(model.pieces)]
        self.decimal = [str(k) for k in range(self.size)]
        if any(MARK in piece.lstrip(MARK) for piece in self.id_of) or MARK not in self.id_of or not self.byte_ids:
            self.cut = re.compile(r"(?s).+").findall  # an entry might span any place: one unit
        else:
            longer = {c for piece in self.id_of if len(piece) > 1 for c in piece}
            alone = "".join(c for c in "\n\r\t" if c not in longer)
            self.cut = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else "")).findall
        self.known: dict[str, bytes] = {}  # ids of units, little-endian uint32
        self.older: dict[str, bytes] = {}  # those before them
        self.doubtful: set[str] = set()  # units for which the library has other ids
        pairs = {(a, b): k for piece, k in self.id_of.items() for n in range(1, len(piece))
                 if (a := self.id_of.get(piece[:n])) is not None and (b := self.id_of.get(piece[n:])) is not None}
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], self.size ** 2)  # one that no pair has, for vocabularies without any
        self.pair_ids = np.append(np.array([*pairs.values()], np.int32)[order], np.int32(0))
        self.pair_costs = np.array([-model.pieces[k].score for k in self.pair_ids.tolist()])
        self.entry_of = np.full(0x110000, -1, np.int32)  # by code point
        for piece, k in self.id_of.items():
            if len(piece) == 1:
                self.entry_of[ord(piece)] = k

    def merge(self, unit: str) -> list[str]:
        """The symbols left when the agenda of a unit is empty."""
        symbols: list[str | None] = list(unit)
        n, cost = len(symbols), self.cost
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(cost[pair], k, k + 1, pair) for k in range(n - 1) if (pair := unit[k:k + 2]) in cost]
        heapq.heapify(agenda)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = end = after[right]
            if end < n:
                before[end] = left
                if (pair := joined + symbols[end]) in cost:
                    heapq.heappush(agenda, (cost[pair], left, end, pair))
            if (start := before[left]) >= 0 and (pair := symbols[start] + joined) in cost:
                heapq.heappush(agenda, (cost[pair], start, left, pair))
        return [s for s in symbols if s is not None]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost (infinite: not in the agenda) and joined entry of adjacent entries."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_costs[at], np.inf), self.pair_ids[at]

    def merge_rows(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for many units of one length, a row of entries each: a row of costs is its agenda, of which every
        step takes the least, the leftmost of equals.  Gives (row numbers, rows of the entries left)."""
        rows = np.arange(len(symbols))
        costs, joined = self._pairs(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if symbols.shape[1] == 1:
                yield rows, symbols
                return
            best = costs.argmin(1)
            more = np.isfinite(costs[np.arange(len(rows)), best])
            if not more.all():
                yield rows[~more], symbols[~more]
                rows, symbols, costs, joined, best = (x[more] for x in (rows, symbols, costs, joined, best))
            at = np.arange(len(rows))
            symbols[at, best] = joined[at, best]
            symbols, costs, joined = _without(symbols, best + 1), _without(costs, best), _without(joined, best)
            for side in (best - 1, best):  # the pairs that the joined entry makes with its neighbours
                own = np.flatnonzero((side >= 0) & (side < costs.shape[1]))
                where = side[own]
                costs[own, where], joined[own, where] = self._pairs(symbols[own, where], symbols[own, where + 1])

    def _spelled(self, units: list[str]) -> list[list[int]]:
        """The ids of many units: short ones whose characters are all entries by rows, the others one by one."""
        found: list[list[int] | None] = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for k, unit in enumerate(units):
            by_length.setdefault(len(unit), []).append(k)
        for n, own in by_length.items():
            if n <= ROW_LENGTH:
                codes = np.frombuffer("".join([units[k] for k in own]).encode("utf-32-le"), "<u4")
                rows = self.entry_of[codes].reshape(len(own), n)
                known = np.flatnonzero((rows >= 0).all(1))
                for at, left in self.merge_rows(rows[known]):
                    for k, ids in zip(known[at].tolist(), left.tolist(), strict=True):
                        found[own[k]] = ids
        return [self.spell(self.merge(unit)) if ids is None else ids for unit, ids in zip(units, found, strict=True)]

    def spell(self, symbols: Iterable[str]) -> list[int]:
        ids: list[int] = []
        fresh = True  # neighbouring unknown symbols share one unknown id
        for symbol in symbols:
            found = self.id_of.get(symbol)
            if found is not None:
                ids.append(found)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in symbol.encode()]
            elif fresh:
                ids.append(self.unknown)
            fresh = found is not None
        return ids

    def learn(self, units: Iterable[str]) -> None:
        """Work out units not met before, and check them against the library in one call (or take the library's ids)."""
        if len(self.known) > (self.cache or CACHE_UNITS) // 2:
            self.known, self.older = {}, self.known
        units = {u for u in units if u not in self.known}
        self.known |= {u: self.older[u] for u in units if u in self.older}  # what is met again stays
        new = [u for u in units if u not in self.older]
        # the library puts a mark in front itself; a unit without one is compared behind it
        asked = self.library.encode([u.removeprefix(MARK).replace(MARK, " ") for u in new], num_threads=1)
        if not self.own:
            bare = [k for k, u in enumerate(new) if u[0] != MARK or u == MARK]  # the library would see another text
            for k, ids in zip(bare, self._spelled([new[k] for k in bare]), strict=True):
                asked[k] = ids
            self.known |= {u: array("I", ids).tobytes() for u, ids in zip(new, asked, strict=True)}
            return
        for unit, ids, theirs in zip(new, self._spelled(new), asked, strict=True):
            self.known[unit] = array("I", ids).tobytes()
            if unit == MARK:  # the library sees the empty text
                theirs = [self.library.piece_to_id(MARK)]
            if theirs != (ids if unit[0] == MARK else self.spell(self.merge(MARK + unit))):
                self.doubtful.add(unit)

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, bool]]:
        """The ids of each text (little-endian uint32), and whether all its units agree with the library's (always, if taken from it)."""
        for lo in range(0, len(texts), 500):
            cut = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts[lo:lo + 500]]
            self.learn(u for units in cut for u in units)
            for units in cut:
                yield b"".join(map(self.known.__getitem__, units)), not self.doubtful or self.doubtful.isdisjoint(units)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(next(self.encode_all([text]))[0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids: runs of byte entries as UTF-8, each byte that is none as U+FFFD; the first mark goes."""
        out, run, first = [], b"", True
        for k in [*ids, None]:
            byte = None if k is None else self.byte_of.get(k)
            if byte is not None:
                run += byte
                continue
            out.append(_utf8(run))
            run = b""
            if k is None or k in self.control:
                continue
            text = self.text_of[k].decode()
            out.append(text[1:] if first and not any(out) and text[:1] == " " and k != self.unknown else text)
            first = False
        return "".join(out)


def _without(table: np.ndarray, column: np.ndarray) -> np.ndarray:
    """A table without one column of each row."""
    keep = np.ones(table.shape, bool)
    keep[np.arange(len(table)), column] = False
    return table[keep].reshape(len(table), table.shape[1] - 1)


def _utf8(run: bytes) -> str:
    out = ""
    while run:
        try:
            return out + run.decode()
        except UnicodeDecodeError as e:
            out += run[:e.start].decode() + "�"
            run = run[e.start + 1:]
    return out


_vocabularies: dict[tuple[str, int, bool], Vocabulary] = {}


def vocabulary(path: str, cache: int = 0, own: bool = True) -> Vocabulary:
    """The worker's vocabulary of a model file; kept between tasks of one Python worker."""
    key = path, cache, own
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(*key)
    return _vocabularies[key]


class _Text:
    """One text's ids and what is derived from them."""

    def __init__(self, entries: Vocabulary, ids: bytes, agrees: bool):
        self.entries, self.ids, self.agrees = entries, np.frombuffer(ids, "<u4"), agrees

    def listed(self) -> bytes:
        return ",".join(map(self.entries.decimal.__getitem__, self.ids.tolist())).encode()

    def decoded(self) -> bytes:
        """Ids of whole texts spell whole characters, and the first entry begins with the mark put there."""
        return b"".join(map(self.entries.text_of.__getitem__, self.ids.tolist()))[1:]


#: What ``round_trip`` can return of a text: type and value.
COLUMNS: dict[str, tuple[str, pa.DataType, Callable[[_Text], object]]] = {
    "n_tokens": ("long", pa.int64(), lambda t: len(t.ids)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda t: t.ids.astype(np.int32)),
    "ids_sha256": ("string", pa.string(), lambda t: sha256(t.listed()).hexdigest()),
    "decoded": ("string", pa.string(), lambda t: t.decoded().decode()),
    "decoded_sha256": ("string", pa.string(), lambda t: sha256(t.decoded()).hexdigest()),
    "agrees": ("boolean", pa.bool_(), lambda t: t.agrees),
}


def round_trip(docs: DataFrame, model: str, columns: Iterable[str] = ("n_tokens", "ids", "decoded", "agrees")) -> DataFrame:
    """doc_id and the asked for ``columns`` of each row's text: its ids and what they decode to, or their digests."""
    asked = {c: COLUMNS[c] for c in columns}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = vocabulary(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                texts = (_Text(entries, *found) for found in entries.encode_all(some.column(1).to_pylist()))
                rows = [[value(t) for _, _, value in asked.values()] for t in texts]
                made = zip(zip(*rows, strict=True), asked.values(), strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, kind) for c, (_, kind, _) in made)], ["doc_id", *asked])

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, "doc_id long" + "".join(f", {c} {kind}" for c, (kind, _, _) in asked.items()))


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and ``decoded``, the text of ``ids`` (array<int>; null: empty), for ids from anywhere."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(model).decode
        for batch in batches:
            texts = pa.array([decode(ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")

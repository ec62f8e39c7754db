"""Byte-level BPE ids of whole texts with a public vocabulary, through the ``tokenizers`` library.

Texts are cut before every blank and line feed, and before punctuation behind a letter or digit.  The cuts are found
in the UTF-8 bytes of many texts at a time; each distinct piece among them is looked up once, in what the worker remembers (up
to ``CACHE_ENTRIES`` pieces) or by the library, and the ids are put together by arrays.  Cutting there never changes
the ids: the library's own splitting rule ends a unit before a single blank or line feed in any case.  Only
runs of three or more white-space characters, or two at the end, form one unit; texts with those go to the
library whole.  So do texts that hold the string of a special token, which the library by default turns into that
token's id; with ``special=False`` such strings are ordinary text.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

CACHE_ENTRIES = 400_000
CHUNK = 4_000_000  # characters that are cut up at a time
JOINED = 32  # new words that the model takes in one call
_RUNS = re.compile(r"\s{3}|\s\s\Z")
_MARKS = re.compile(r"[^\w\s][.,]|[ _][.,]")  # a comma or stop that belongs to the unit before it
_SPACED = re.compile(r"\s[.,]")  # a cut there would show white space as the end of a text


_BEFORE_MARKS = [c for c in map(chr, range(32, 127)) if not c.isalnum()]


def _marked(text: str) -> bool:
    """Whether ``_MARKS`` is found; in printable ASCII by plain searches, which are several times as fast."""
    if not (text.isascii() and text.replace("\n", " ").isprintable()):
        return bool(_MARKS.search(text))
    return any(c in text and (c + "," in text or c + "." in text) for c in _BEFORE_MARKS)


def _plain(text: str) -> bool:
    """Whether pieces may be encoded one by one: no NUL, no long or final run of white space."""
    if "\x00" in text:
        return False
    single = len(text.split()) == text.count(" ") + text.count("\n") + 1
    # the count proves it only without other white space, of which no character is printable
    return single and text.replace("\n", " ").isprintable() or not _RUNS.search(text)


_SPACE, _CUT, _STOP, _LETTER, _NUL, _DOUBT, _WIDE = (1 << k for k in range(7))


def _byte_kinds() -> bytes:
    """What a byte of UTF-8 may be: white space, a place to cut, punctuation, an ASCII letter or digit, NUL, the first byte of
    characters among which there is other white space, any byte beyond ASCII."""
    kinds = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        kinds[b] = _SPACE * c.isspace() | _CUT * (c in " \n") | _STOP * (c in string.punctuation) | _LETTER * c.isalnum() | _NUL * (b == 0)
    kinds[128:] = _WIDE
    kinds[sorted({chr(c).encode()[0] for c in range(128, 0x110000) if chr(c).isspace()})] |= _DOUBT
    return kinds.tobytes()


_KINDS = _byte_kinds()


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


class _Known(dict):
    """Ids by piece, computed on first use and kept up to the limit."""

    def __init__(self, encode: Callable[[str], bytes], entries: int):
        self.encode, self.entries = encode, entries

    def __missing__(self, piece: str) -> bytes:
        return self.keep(piece, self.encode(piece))

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) < self.entries and len(piece) <= 40:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool = True, cache: int = 0):
        import regex
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not special
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        bpe = rules["model"]
        self.added = [t["content"] for t in rules.get("added_tokens", []) if special or not t.get("special")]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        # the same model without the library's own cache, which only costs time below ours
        self.model = models.BPE(vocab=bpe["vocab"], merges=merges, cache_capacity=0)
        self.alphabet = _byte_alphabet()
        self.begins = {k for entry, k in bpe["vocab"].items() if entry[0] in "ĠĊ"}
        edges = {p for entry in bpe["vocab"] for p in zip(entry, entry[1:])}
        self.before = {a for a, b in edges if b in "ĠĊ" and a not in "ĠĊ"}  # what an entry holds before a blank or line feed
        self.behind = {b for a, b in edges if a == "Ċ"}  # and behind a line feed
        self.units = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known = _Known(self._piece, cache or CACHE_ENTRIES)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes()
                for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() and unit[1:].isalpha() and unit[0] == " ":
            mapped = "Ġ" + unit[1:]
        else:
            mapped = unit.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        if piece.isascii() and piece[0] == " " and piece[1:].isalpha():
            return array("I", [t.id for t in self.model.tokenize("Ġ" + piece[1:])]).tobytes()
        if piece[0] == " " and max(piece) < "ɐ":
            if piece[1:].isalpha():
                return self._unit(piece)
            if piece[-1] in ",.!?;:" and piece[1:-1].isalpha():  # word and mark are two units
                return self.known[piece[:-1]] + self.known[piece[-1]]
        if not piece.isascii() and max(piece) >= "ɐ":  # beyond Latin the library alone decides what a letter is
            return self._library([piece])[0]
        return b"".join(map(self._unit, self.units(piece)))

    def _words(self, mapped: list[str]) -> list[bytes]:
        """Ids of words behind a blank or line feed, many in one call; none may end with a byte that an entry holds before a
        blank or line feed, so no entry spans two words."""
        out: list[bytes] = []
        for lo in range(0, len(mapped), JOINED):
            ids = [t.id for t in self.model.tokenize("".join(mapped[lo:lo + JOINED]))]
            begins, data = [k for k, x in enumerate(ids) if x in self.begins], array("I", ids).tobytes()
            out += [data[4 * a:4 * b] for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        known = self.known
        found = list(map(known.get, pieces))
        words: dict[int, str] = {}
        for k in (new := [k for k, ids in enumerate(found) if ids is None]):
            piece = pieces[k]
            if piece[0] in " \n" and piece[1:].isalpha() and (piece.isascii() or max(piece) < "ɐ"):
                own = piece[1:] if piece.isascii() else piece[1:].encode().decode("latin-1").translate(self.alphabet)
                if own[-1] not in self.before and (piece[0] == " " or own[0] not in self.behind):
                    words[k] = ("Ġ" if piece[0] == " " else "Ċ") + own
        for k, ids in zip(words, self._words(list(words.values())), strict=True):
            found[k] = known.keep(pieces[k], ids)
        for k in new:
            if found[k] is None:
                found[k] = known[pieces[k]]
        return found

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHUNK:
                out += self._encode(some)
                some, size = [], 0
        return out + self._encode(some)

    def _encode(self, texts: list[str]) -> list[bytes]:
        utf8 = [t.encode() for t in texts]
        joined = b"".join(utf8)
        if not joined:
            return [b""] * len(texts)
        data, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(_KINDS), np.uint8)
        length = np.fromiter(map(len, utf8), np.int64, len(texts))
        ends = np.cumsum(length)

        def owners(at: np.ndarray) -> np.ndarray:
            return np.searchsorted(ends, at, "right")

        whole = np.zeros(len(texts), bool)
        space = kinds & _SPACE
        two = np.flatnonzero(space[:-1] & space[1:])  # white space before white space
        own = owners(two)
        two, own = two[two + 1 < ends[own]], own[two + 1 < ends[own]]
        whole[own[two + 2 == ends[own]]] = True
        whole[own[:-1][(np.diff(two) == 1) & (np.diff(own) == 0)]] = True
        whole[owners(np.flatnonzero(kinds & _NUL))] = True
        for k in np.unique(owners(np.flatnonzero(kinds & _DOUBT))).tolist():
            whole[k] = not _plain(texts[k])
        if self.added:
            whole |= np.fromiter((any(t in text for t in self.added) for text in texts), bool, len(texts))

        stops = np.flatnonzero(kinds & _STOP)
        before, second = kinds[np.maximum(stops - 1, 0)], data[np.maximum(stops - 2, 0)]
        parted = (before & _LETTER) > 0
        last = data[np.maximum(stops - 1, 0)]
        latin = (before & _WIDE > 0) & (second == 0xC3) & (last != 0x97) & (last != 0xB7)  # U+00C0 to U+00FF but the two signs
        other = np.flatnonzero((before & _WIDE > 0) & ~latin & ((data[stops] == ord(",")) | (data[stops] == ord("."))))
        if len(other):
            own = owners(stops[other])
            marked = {k: bool(_marked(texts[k]) or _SPACED.search(texts[k])) for k in np.unique(own).tolist()}
            parted[other] = [not marked[k] for k in own.tolist()]
        cuts = kinds & _CUT
        cuts[stops[parted | latin]] = 1
        cuts[(ends - length)[length > 0]] = 1

        out = [b""] * len(texts)
        if whole.any():
            for k, ids in zip(np.flatnonzero(whole).tolist(), self._library([t for t, w in zip(texts, whole, strict=True) if w]), strict=True):
                out[k] = ids
            kept = np.repeat(~whole, length)
            data, cuts = np.ascontiguousarray(data[kept]), cuts[kept]
            length[whole] = 0
            ends = np.cumsum(length)
        at = np.append(np.flatnonzero(cuts), len(data)).astype(np.int32)
        if len(at) > 1:
            coded = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
            found = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat, index = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
            n = size[index]
            upto = np.append(0, np.cumsum(n))
            ids = flat[np.repeat((np.cumsum(size) - size)[index] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
            end = 4 * upto[np.searchsorted(at, ends)]
            for k in np.flatnonzero(length).tolist():
                out[k] = ids[end[k - 1] if k else 0:end[k]]
        return out


_encoders: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, special: bool = True, cache: int = 0) -> Encoder:
    """The worker's encoder for a vocabulary file; kept between tasks of one Python worker."""
    key = path, special, cache
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]

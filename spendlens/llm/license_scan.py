"""Licence scan by patience alignment.

A text and a template are aligned on the words that occur exactly once in both: the longest run of them that ascends in both
is kept, and the gaps between are aligned the same way, after equal words at their ends have been matched.  A template's
coverage is the share of its words that are matched.

A template is looked for in windows of one and a half times its length that hold enough of its words to reach the wanted
coverage at all (a necessary condition, checked for every place of the whole text by running sums), so that copies further on
in a long text are found too and do not hide each other's unique words.  Windows whose longest common subsequence with the
template is too short are not aligned, nor those after it that end too few words later to make up for it: both are exact, and a
text that only shuffles a template's words costs few windows.

Defined results: one row per copy found, none for null or empty texts or texts without a licence; a null doc_id and repeated
rows are kept; of overlapping windows the first that reaches the coverage counts; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import LICENSES

CACHE_ENTRIES = 300_000
_MARKS = ".,;:!?\"'()[]{}<>*#/|-%&$"


def template_words(text: str) -> list[str]:
    return [w for w in (x.lower().strip(_MARKS) for x in text.split()) if w]


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first, that ascends in the second as well."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        place = bisect_left(ends, b)
        before[k] = at[place - 1] if place else -1
        ends[place:place + 1] = [b]
        at[place:place + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Matched (place in text, place in template), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, z, b, y = todo.pop()
        while a < z and b < y and text[a] == template[b]:
            out.append((a, b))
            a, b = a + 1, b + 1
        while a < z and b < y and text[z - 1] == template[y - 1]:
            z, y = z - 1, y - 1
            out.append((z, y))
        if a >= z or b >= y:
            continue
        here, there = Counter(text[a:z]), Counter(template[b:y])
        place = {w: k for k, w in enumerate(template[b:y], b) if there[w] == 1}
        anchors = _ascending([(k, place[w]) for k, w in enumerate(text[a:z], a) if here[w] == 1 and w in place])
        out += anchors
        edges = [(a - 1, b - 1), *anchors, (z, y)]
        if anchors:
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def common_length(text: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a text and a template of ``n`` words: one step on n-bit numbers a word.

    ``masks`` holds the template's places of each word as bits.  No alignment matches more words.
    """
    free = whole = (1 << n) - 1
    for w in text:
        here = free & masks.get(w, 0)
        free = (free + here | free - here) & whole
    return n - free.bit_count()


class Scanner:
    def __init__(self, licenses: dict[str, str], coverage: float):
        words = {n: template_words(t) for n, t in licenses.items()}
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for t in words.values() for w in t}))}
        self.templates = {n: [self.number[w] for w in t] for n, t in words.items() if t}
        self.coverage = coverage
        self.member, self.masks = {}, {}
        for n, t in self.templates.items():
            self.member[n] = np.zeros(len(self.number) + 1, np.int32)
            self.member[n][t] = 1
            self.masks[n] = {w: sum(1 << k for k, x in enumerate(t) if x == w) for w in set(t)}
        number = self.number

        class Known(dict):
            def __missing__(self, word: str) -> int:
                value = number.get(word.lower().strip(_MARKS), 0)
                if len(self) < CACHE_ENTRIES and len(word) <= 40:
                    self[word] = value
                return value

        self.known = Known()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, coverage, first word, last word) of every copy."""
        words = (text or "").split()
        ids = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        places = np.flatnonzero(ids)  # words of no template neither match nor anchor
        if not len(places):
            return []
        kept = ids[places]
        out = []
        for name, template in self.templates.items():
            need = max(1, int(np.ceil(self.coverage * len(template))))
            own = self.member[name][kept] > 0
            if own.sum() < need:
                continue
            at, word = places[own], kept[own].tolist()
            reach = len(template) * 3 // 2 + 3
            end = np.searchsorted(at, at + reach, "left")
            starts = np.flatnonzero(end - np.arange(len(at)) >= need).tolist()
            done, idle = -1, -1
            for s in starts:
                if s <= done or end[s] < idle:
                    continue
                common = common_length(word[s:int(end[s])], self.masks[name], len(template))
                if common < need:  # every further word adds one match at most, so windows that end before this cannot do
                    idle = end[s] + need - common
                    continue
                matched = align(word[s:int(end[s])], template)
                if len(matched) >= need:
                    begin = s + matched[0][0]  # once more from where the copy begins, so that its end is in the window
                    again = align(word[begin:int(end[begin])], template)
                    if len(again) >= len(matched):
                        s, matched = begin, again
                    first, last = s + matched[0][0], s + matched[-1][0]
                    out.append((name, len(matched) / len(template), int(at[first]), int(at[last])))
                    done = last
        return out


def scan_licenses(docs: DataFrame, licenses: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, first_word, last_word, span): every copy of a template in every whole text."""
    given = licenses if licenses is not None else LICENSES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(given, coverage)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                for name, share, first, last in scanner.scan(text):
                    out.append((doc_id, name, share, first, last, " ".join(text.split()[first:last + 1])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "license", "coverage", "first_word", "last_word", "span"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, coverage double, first_word int, last_word int, span string")

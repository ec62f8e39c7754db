"""Phrase collocations per language: phrases of two to four words that hold together, by counts of all shorter phrases.

Counting: no phrase is more frequent than a pair of words in it.  So all neighbouring pairs are counted first, by a 64-bit hash, and
the hashes with enough occurrences go to the tasks as a bitmap, which may let rare pairs pass but never stops a frequent one.
Then every task puts the longest word sequence (up to four words, ended before a pair the bitmap does not hold) that starts at each
word into a HAT-trie (``hat_trie``); a shorter phrase's count is the sum over the sequences that begin with it, that is over its subtree.  The
trie spills whole subtrees as sorted runs, and each run goes out as rows of (language, sequence, count), one-word
subtrees as their sums.  Runs of all tasks are merged per prefix partition, hashed by the language and the first two words:
there every sequence whose first two words are frequent adds its count to all its beginnings (no longer phrase is more frequent
than its beginning).  Pairs of words that a sample shows to be hot are parted by
the third word as well, and their own sums travel alone, so that no word, pair or language meets in one task.

A phrase counts as a candidate from ``least`` occurrences.  Cut after its first k words it has l = f(first part) and
r = f(rest); its score is the least of floor(2,000,000 a / (l + r)) over its cuts, the first of equals.  A candidate that
lies inside a longer one with at least ``share`` percent of its occurrences is dropped.  Every part of a candidate is at
least as frequent as it, so all lookups are among the frequent phrases alone.

Defined results: a null text is empty, a null language is ``und``; only A-Z is lower-cased, only blank and tab part words and
only ``. , ; : ! ?`` and line breaks part pieces, any other character is part of a word; words of any length count; repeated
rows and null ids count as often as they occur; ties go by score, count, then the phrase in byte order; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hat_trie import WORD_BITS, WORDS, HatTrie
from .scratch import cut

LIMIT = 600_000  # entries of all tries of a task
BATCH = 1 << 16  # sequences given to a trie at a time
PART = 200_000  # words of a text that are numbered at a time
PARTS = 4
SALTS = 256
SOME = 1_000_000  # bytes of text split at a time, at least one text
PAIRS = 2_000_000  # pairs of a task that are counted at a time
ROWS = 50_000  # rows of a batch that leaves a task
PAIR_PARTS = 2  # partitions of hashes for each of Spark's own
MOST_BITS = 28  # the bitmap of pairs takes 32 MB at most; a fuller one only lets more rare pairs pass


def _split(texts: pa.Array) -> list[list[str]]:
    """Lower-cased words (and empty strings) of each text, with a line feed before, between and after pieces."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    low = pc.replace_substring_regex(low, r"[.,;:!?\x0A-\x0D]+", " \n ")
    return [t.replace("\t", " ").split(" ") for t in low.to_pylist()]


def _words(texts: pa.Array) -> pa.Array:
    """Lower-cased words of all texts in one row, with a line feed before, between and after pieces."""
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    low = pc.replace_substring(pc.replace_substring_regex(low, r"[.,;:!?\x0A-\x0D]+", " \n "), "\t", " ")
    return _filled(pc.split_pattern(pc.binary_join_element_wise("\n", low, " "), " ").flatten())


def _filled(words: pa.Array) -> pa.Array:
    return words.filter(pc.not_equal(words, ""))


def _entries(words: pa.DictionaryArray) -> list[str]:
    return words.dictionary.to_numpy(zero_copy_only=False).tolist()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """(language, words of its texts) of some rows at a time."""
    rows = max(1, min(2000, SOME * batch.num_rows // max(batch.nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        langs, texts = batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows)
        for lang in pc.unique(langs).to_pylist():
            yield lang, _words(texts.filter(pc.equal(langs, lang)))


def _pairs(lang: str, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbours (the last word is its own), and which of them are within one piece."""
    entries, index = _entries(words), words.indices.to_numpy()
    own = np.fromiter(map(crc32, map(str.encode, entries)), np.uint64, len(entries))[index]
    word = np.array([w != "\n" for w in entries], bool)[index]
    pairs = (own << np.uint64(32) | np.append(own[1:], own[-1:])) ^ np.uint64(crc32(lang.encode()) * 0x9E3779B1)
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        pairs *= np.uint64(factor)
        pairs ^= pairs >> np.uint64(32)
    return pairs, word & np.append(word[1:], False)


def _counts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The hashes held, each once with its number, in small batches; nothing stays held."""
    pairs = np.concatenate([np.empty(0, np.uint64), *held])
    held.clear()
    pairs.sort()
    ends = np.flatnonzero(np.append(pairs[1:] != pairs[:-1], True)[:len(pairs)])
    for lo in range(0, len(ends), ROWS):
        own = ends[lo:lo + ROWS]
        n = np.diff(own, prepend=ends[lo - 1] if lo else -1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[own].view(np.int64)), pa.array(n, pa.int64())], ["pair", "n"])


def _sequences(ids: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """The longest sequence of up to four words from each word, as rows; pieces are parted by 0, and no sequence goes on
    where a word is not ``joined`` to the next."""
    padded = np.append(ids, np.zeros(3, ids.dtype))
    rows, joined = np.stack([padded[k:k + len(ids)] for k in range(4)], 1), np.append(joined, np.zeros(3, bool))
    for k in range(1, 4):
        rows[:, k] *= (rows[:, k - 1] > 0) & joined[k - 1:k - 1 + len(ids)]
    return rows[rows[:, 0] > 0]


class _Counter:
    """One task's tries, one per language, over one numbering of words."""

    def __init__(self, limit: int, hot: dict[str, list[tuple[str, str]]], likely: np.ndarray | None = None):
        self.limit, self.hot, self.likely, self.tries, self.held = limit, hot, likely, {}, {}
        self._renumber()

    def _renumber(self) -> None:
        """Word ids from 1 on in the order of arrival; line feed, put between pieces, is 0."""
        self.ids, self.spelled = {"\n": 0}, None

    def _joined(self, lang: str, words: pa.DictionaryArray) -> np.ndarray:
        """Whether each word and the next may be a frequent pair."""
        pairs, joined = _pairs(lang, words)
        if self.likely is None:
            return joined
        at = pairs >> np.uint64(64 - (8 * len(self.likely)).bit_length() + 1)
        return joined & (self.likely[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0)

    def add(self, lang: str, words: list[str] | pa.Array) -> Iterator[pa.RecordBatch]:
        """Hold a text's sequences; whole batches go to the language's trie.  A long text goes in parts, each with the up to
        three words of its piece that follow it."""
        words = _filled(pa.array(words, pa.string()) if isinstance(words, list) else words)
        for lo in range(0, len(words), PART):
            after = [*words.slice(lo + PART, 3).to_pylist(), "\n"].index("\n")
            own = words.slice(lo, PART + after).dictionary_encode()
            entries = _entries(own)
            new = [w for w in entries if w not in self.ids]
            if len(self.ids) + len(new) > WORDS:
                yield from self.finish()  # numbers run out: all is spilled, and the numbering starts anew
                new = [w for w in entries if w not in self.ids]
            self.ids |= zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True)
            numbers = np.fromiter(map(self.ids.__getitem__, entries), np.int64, len(entries))[own.indices.to_numpy()]
            rows = _sequences(numbers, self._joined(lang, own))
            held = self.held.setdefault(lang, [])
            held.append(rows[:len(rows) - after])
            if sum(map(len, held)) >= BATCH:
                yield from self._count(lang)

    def _count(self, lang: str) -> Iterator[pa.RecordBatch]:
        held = self.held.pop(lang, [])
        if held:
            yield from self._insert(lang, np.concatenate(held))

    def _insert(self, lang: str, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if lang not in self.tries:
            self.tries[lang] = HatTrie(self.limit)
        for run in self.tries[lang].add(rows):
            yield from self._rows(lang, run)
        while sum(t.sizes.total() for t in self.tries.values()) > self.limit:  # many languages share the limit
            largest = max(self.tries, key=lambda x: self.tries[x].sizes.total())
            for run in self.tries[largest].spill(self.tries[largest].sizes.total() // 2):
                yield from self._rows(largest, run)

    def finish(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.held):
            yield from self._count(lang)
        for lang, trie in self.tries.items():
            for run in trie.spill():
                yield from self._rows(lang, run)
        self.tries = {}
        self._renumber()

    def _spelled(self) -> pa.Array:
        """The words by number, from 1 on."""
        if self.spelled is None or len(self.spelled) != len(self.ids) - 1:
            self.spelled = pa.array(list(self.ids)[1:], pa.string())
        return self.spelled

    def _rows(self, lang: str, run: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A sorted run as rows: sequences of two to four words, the sums of one-word subtrees, and those of hot pairs."""
        words, n = run
        long = words[:, 1] > 0
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "phrase": pa.array([""]), "least": pa.array([1], pa.int8()),
                                          "n": pa.array([n.sum()], pa.int64())})
        yield from self._batches(lang, *_sums(words, n, 1), 1)
        pairs = [self.ids[a] << WORD_BITS | self.ids[b] for a, b in self.hot.get(lang, ()) if a in self.ids and b in self.ids]
        hot = np.isin(words[:, 0] << WORD_BITS | words[:, 1], pairs)
        if hot.any():
            yield from self._batches(lang, *_sums(words[hot], n[hot], 2), 2)
            yield from self._batches(lang, words[hot & (words[:, 2] > 0)], n[hot & (words[:, 2] > 0)], 3)
        yield from self._batches(lang, words[long & ~hot], n[long & ~hot], 2)

    def _batches(self, lang: str, words: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        spelled = self._spelled()
        for lo in range(0, len(words), ROWS):
            own = words[lo:lo + ROWS]
            size = int((own > 0).any(0).sum())
            parts = [spelled.take(pa.array(own[:, k] - 1, mask=own[:, k] == 0)) for k in range(size)]
            phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip") if size > 1 else parts[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(own), np.int32))), phrase,
                                              pa.array(np.full(len(own), least, np.int8)), pa.array(n[lo:lo + ROWS])],
                                             ["lang", "phrase", "least", "n"])


def _sums(words: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of a sorted run's subtrees under its first ``size`` words."""
    if not len(words):
        return words, n
    new = np.flatnonzero(np.append(True, (np.diff(words[:, :size], axis=0) != 0).any(1)))
    rows = np.zeros((len(new), words.shape[1]), words.dtype)
    rows[:, :size] = words[new, :size]
    return rows, np.add.reduceat(n, new)


def hot_pairs(docs: DataFrame, rows: int = 2000, share: float = 0.002) -> dict[str, list[tuple[str, str]]]:
    """By language, the pairs of words with at least ``share`` of all pairs in a sample of about ``rows`` texts: at most
    1 / share.  They only decide where rows meet, never what counts: sequences under such a pair are parted by their third
    word as well."""

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for lang, words in zip(batch.column(0).to_pylist(), _split(batch.column(1)), strict=True):
                words = [w for w in words if w]
                found.update((lang, a, b) for a, b in zip(words, words[1:]) if a != "\n" != b)
            keys = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), pa.array(found.values(), pa.int64())],
                                             ["lang", "a", "b", "n"])

    counts = cut(_plain(docs).sample(min(1.0, rows / max(docs.count(), 1)), 7).mapInArrow(pairs, "lang string, a string, b string, n long").groupBy(
        "lang", "a", "b").agg(F.sum("n").alias("n")), "sampled-pairs")
    least = (counts.agg(F.sum("n")).first()[0] or 0) * share
    out: dict[str, list[tuple[str, str]]] = {}
    for r in counts.where(F.col("n") >= least).collect():  # at most 1 / share rows
        out.setdefault(r["lang"], []).append((r["a"], r["b"]))
    return out


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def likely_pairs(docs: DataFrame, least: int) -> Broadcast:
    """A bitmap of the hashes (their first bits) that at least ``least`` neighbouring pairs of words have, 16 bits or more a hash
    up to ``MOST_BITS``.  It holds every pair with so many occurrences."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for lang, words in _by_language(batch):
                pairs, within = _pairs(lang, words.dictionary_encode())
                held.append(pairs[within])
                if sum(map(len, held)) >= PAIRS:
                    yield from _counts(held)
        yield from _counts(held)

    # most of a task's hashes are different already, so they meet first and are summed then: no table of all of them before the shuffle
    parts = PAIR_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _plain(docs).mapInArrow(count, "pair long, n long").repartition(parts, "pair")
    counted = met.groupBy("pair").agg(F.sum("n").alias("n"))
    found = cut(counted.where(F.col("n") >= least).select("pair"), "likely-pairs")
    bits = min(MOST_BITS, max(15, (16 * found.count()).bit_length()))
    at = F.shiftrightunsigned("pair", 64 - bits) + 1  # Spark's bitmaps count from 1 on
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    blocks = found.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for r in blocks.toLocalIterator():  # 4 KB each
        lo = (r["block"] - 1) * len(r["bits"])
        bitmap[lo:lo + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bitmap)


def runs(docs: DataFrame, limit: int = LIMIT, hot: dict[str, list[tuple[str, str]]] | None = None, likely: Broadcast | None = None
         ) -> DataFrame:
    """lang, phrase, least, n: what the tasks' tries spill.  A phrase's count goes to all its beginnings of ``least`` words or
    more: 1 for words, 2 for sequences, 3 for sequences under a ``hot`` pair, whose own count is a row with 2.
    The empty phrase counts all words.  Phrases with a pair that ``likely`` does not hold are left out or counted in part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Counter(limit, hot or {}, likely.value if likely else None)
        for batch in batches:
            for lang, words in _by_language(batch):
                yield from own.add(lang, words)
        yield from own.finish()

    return _plain(docs).mapInArrow(run, "lang string, phrase string, least byte, n long")


def frequent(spilled: DataFrame, least: int) -> DataFrame:
    """lang, phrase, size, f of all phrases of one to four words with f >= least, and size 0: all words of the language."""
    stem = F.expr("substring_index(phrase, ' ', least)")
    # prefix partitions; a row stands for up to three phrases, so four times as many as Spark's own hold them without spilling
    parts = PARTS * int(spilled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = spilled.repartition(parts, "lang", stem)
    size = F.expr("length(phrase) - length(replace(phrase, ' ', '')) + 1")
    begins = F.expr("transform(sequence(cast(least as int), size), k -> substring_index(phrase, ' ', k))")
    # no phrase is more frequent than its beginning: within its partition a rare stem goes with all its sequences, uncounted
    total = F.sum("n").over(Window.partitionBy("order", "stem", "lang"))  # a number first: rows are sorted by it, not by strings
    own = parted.select("lang", stem.alias("stem"), "phrase", "least", "n", size.alias("size"),
                        F.xxhash64("lang", stem).alias("order")).withColumn("total", total)
    merged = own.where((F.col("total") >= least) | (F.col("stem") == "")).select(
        "lang", "stem", F.explode(begins).alias("phrase"), "n").groupBy("lang", "stem", "phrase").agg(F.sum("n").alias("f"))
    return merged.where((F.col("f") >= least) | (F.col("phrase") == "")).select(
        "lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(size).alias("size"), "f")


def _part(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, count), " ")


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, limit: int = LIMIT) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    known = cut(frequent(runs(docs, limit, hot_pairs(docs), likely_pairs(docs, least)), least), "frequent-phrases")
    long = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    lookup = known.where("size > 0").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "f")
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("phrase"), F.lit(1), F.col("k"))).withColumn(
        "rest", _part(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(lookup.withColumnRenamed("f", name), (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))).drop(
            "_lang", "_phrase")
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    places = F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> struct(s, w))))")
    inside = long.where("size >= 3").select("lang", F.col("a").alias("longer"), "phrase", F.explode(places).alias("at")).select(
        F.col("lang").alias("_lang"), _part(F.col("phrase"), F.col("at.s"), F.col("at.w")).alias("_phrase"), "longer")
    covers = inside.groupBy("_lang", "_phrase").agg(F.max("longer").alias("longer"))
    held = weakest.join(covers, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    own = F.coalesce(F.expr(f"cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {int(share)}"), F.lit(True))
    kept = held.where(own).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))  # each part of a language sends its first ``top`` to the last ranking
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    total = known.where("size = 0").select(F.col("lang").alias("_lang"), F.col("f").alias("n"))
    return ranked.join(total, F.col("lang") == F.col("_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

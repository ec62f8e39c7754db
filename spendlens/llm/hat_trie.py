"""A HAT-trie that counts word sequences: a shallow trie over word ids whose leaves are burstable hash containers.

A sequence of up to four words is one packed number.  The trie's first level goes by block of first words, the next ones by
first word, by block of second words and by second word.  Every subtree starts as one hash container (hybrid: it holds
several words' sequences); a container that outgrows ``BURST`` entries bursts into containers one level further down.
Words get ids as they come, so frequent ones share the first blocks, which burst early, and rare ones share containers.

When the trie holds more than ``limit`` entries, its largest subtrees are taken out whole, each as a run sorted by word
ids, until half the limit is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

WORD_BITS = 18
WORDS = (1 << WORD_BITS) - 1  # ids 1 to WORDS; 0 stands for no word
LOW_BITS = 9  # of the first word, kept in the packed number; the rest is the number of its block
BURST = 16_384
#: What is left of a packed number at each level below the blocks of first words.
_LEVELS = (3 * WORD_BITS, 2 * WORD_BITS + LOW_BITS, 2 * WORD_BITS)


class _Node:
    """A hash container of packed numbers, or, once burst, the nodes of the next level."""

    __slots__ = ("children", "counts", "level")

    def __init__(self, level: int):
        self.level, self.counts, self.children = level, Counter(), None

    def add(self, keys: np.ndarray) -> int:
        """Count sorted numbers; how many entries are new."""
        if self.children is not None:
            return sum(self._child(k).add(own) for k, own in self._parts(keys))
        before = len(self.counts)
        self.counts.update(keys.tolist())
        if (now := len(self.counts)) > BURST and self.level < len(_LEVELS):
            held, n = self.run()
            self.children, self.counts = {}, None
            for k, own in self._parts(held):
                child, lo = self._child(k), np.searchsorted(held, own[0])
                child.counts = Counter(dict(zip(own.tolist(), n[lo:lo + len(own)].tolist(), strict=True)))
        return now - before

    def _child(self, k: int) -> _Node:
        if k not in self.children:
            self.children[k] = _Node(self.level + 1)
        return self.children[k]

    def _parts(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        part = keys >> _LEVELS[self.level]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            yield int(part[lo]), keys[lo:hi]

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries below, sorted, and their counts."""
        if self.children is not None:
            runs = [self.children[k].run() for k in sorted(self.children)]
            return tuple(np.concatenate([r[x] for r in runs]) for x in (0, 1))
        keys, n = (np.fromiter(x, np.int64, len(self.counts)) for x in (self.counts.keys(), self.counts.values()))
        order = np.argsort(keys)
        return keys[order], n[order]


class HatTrie:
    """Counts sequences of one to four word ids; ``add`` gives back the runs it had to spill."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.blocks, self.sizes = limit, {}, Counter()

    def add(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Count rows of four word ids (0: none, only at the end of a row); yields spilled runs (rows, counts)."""
        if not len(words):
            return
        block = (words[:, 0] >> LOW_BITS).astype(np.uint16)
        keys = words[:, 0] & (1 << LOW_BITS) - 1
        for k in range(1, 4):
            keys = keys << WORD_BITS | words[:, k]
        order = np.argsort(block, kind="stable")
        block, keys = block[order], keys[order]
        starts = np.flatnonzero(np.diff(block.astype(np.int32), prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            b = int(block[lo])
            if b not in self.blocks:
                self.blocks[b] = _Node(0)
            self.sizes[b] += self.blocks[b].add(np.sort(keys[lo:hi]))
        if self.sizes.total() > self.limit:
            yield from self.spill(self.limit // 2)

    def spill(self, left: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out the largest subtrees until at most ``left`` entries stay."""
        for b, _ in self.sizes.most_common():
            if self.sizes.total() <= left and left:
                break
            keys, n = self.blocks.pop(b).run()
            del self.sizes[b]
            words = np.stack([(keys >> WORD_BITS * (3 - k)) & WORDS for k in range(4)], 1)
            words[:, 0] |= b << LOW_BITS
            yield words, n

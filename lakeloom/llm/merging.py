"""Merges of neighbours in many short words at once: in each round every word's best pair, the leftmost of equal ones."""

from __future__ import annotations

import numpy as np

NEVER = 1 << 22
#: Words whose arrays are held at once: few enough for a processor's cache.
WORDS = 4096


class Merges:
    """Pairs of symbols that merge: the rank of each (the lowest goes first; equal ones from the left) and what it becomes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, becomes: np.ndarray):
        keys = left.astype(np.int64) << 32 | right
        self.bits = max(12, int(len(keys) * 4).bit_length())
        # open addressing; an empty slot holds -1, ranks NEVER
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.becomes = np.full(1 << self.bits, NEVER, np.int32), np.zeros(1 << self.bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] == -1
            first = np.unique(np.where(free, slot, -1), return_index=True)[1]
            first = first[free[first]]
            at, pair = slot[first], todo[first]
            self.keys[at], self.rank[at], self.becomes[at] = keys[pair], rank[pair], becomes[pair]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands, or an empty slot."""
        keys = left << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        far = np.flatnonzero((held != keys) & (held != -1))
        while len(far):
            slot[far] = (slot[far] + 1) & (1 << self.bits) - 1
            held = self.keys[slot[far]]
            far = far[(held != keys[far]) & (held != -1)]
        return slot

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> list[tuple[int, ...]]:
        """symbols: those of all words in a row; sizes: how many each has, one at least. What is left of each word."""
        left, counts = self.flat(symbols, sizes)
        left, stops = left.tolist(), np.cumsum(counts).tolist()
        return [tuple(left[s:e]) for s, e in zip([0, *stops], stops, strict=False)]

    def flat(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in a row, and how many symbols are left of each word."""
        stops = np.cumsum(sizes)
        parts = [self._merged(symbols[stops[i] - sizes[i] : stops[min(i + WORDS, len(sizes)) - 1]], sizes[i : i + WORDS]) for i in range(0, len(sizes), WORDS)]
        left, counts = zip(*parts, strict=True) if parts else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        return np.concatenate(left), np.concatenate(counts)

    def _merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word, sizes, symbols = np.arange(len(sizes)), sizes.copy(), symbols.astype(np.int64)
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        slot = np.zeros(len(symbols), np.int64)
        rank = np.full(len(symbols), NEVER, np.int64)
        inner = np.flatnonzero(~last)
        slot[inner] = self.slots(symbols[inner], symbols[inner + 1])
        rank[inner] = self.rank[slot[inner]]
        while len(word):
            best = np.minimum.reduceat(rank << 40 | np.arange(len(rank)), np.cumsum(sizes) - sizes)
            live = best >> 40 < NEVER
            if not live.all():
                gone = np.repeat(~live, sizes)
                done.append((word[~live], sizes[~live], symbols[gone]))
                # positions move down by what went before them
                at = (best[live] & (1 << 40) - 1) - np.cumsum(np.where(live, 0, sizes))[live]
                word, sizes = word[live], sizes[live]
                symbols, last, slot, rank = (x[~gone] for x in (symbols, last, slot, rank))
            else:
                at = best & (1 << 40) - 1
            if not len(word):
                break
            symbols[at], last[at] = self.becomes[slot[at]], last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, last, slot, rank = (x[keep] for x in (symbols, last, slot, rank))
            sizes -= 1
            at = at - np.arange(len(at))
            rank[at[last[at]]] = NEVER
            before = at[at > 0] - 1
            changed = np.concatenate((at[~last[at]], before[~last[before]]))
            slot[changed] = found = self.slots(symbols[changed], symbols[changed + 1])
            rank[changed] = self.rank[found]
        word, sizes, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word)
        begin, counts = (np.cumsum(sizes) - sizes)[order], sizes[order]
        return symbols[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(symbols))], counts

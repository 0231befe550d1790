"""FM-index over word sequences: suffix order, wavelet matrix of the transform, backward search.

The index holds several sequences, each ended by word 0.  Suffixes are sorted by their
first ``DEPTH`` words, which is enough for patterns of up to ``DEPTH - 1`` words.  The
transform is kept as a wavelet matrix of packed bits with one running count per 64 bits.
"""
from __future__ import annotations

import numpy as np

DEPTH = 64


class _Bits:
    """Packed bits with constant-time counts of the ones before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FmIndex:
    def __init__(self, sequences: list[np.ndarray]):
        """``sequences``: arrays of word numbers from 1 up."""
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        text = np.zeros(int(self.starts[-1]), np.int64)
        for s, start in zip(sequences, self.starts):
            text[start:start + len(s)] = s
        self.text, n = text, len(text)
        self._sort()
        self.sigma = int(text.max(initial=0)) + 1
        transform = text[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels = []
        for level in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bits = (transform >> level & 1).astype(np.uint8)
            self.levels.append((level, _Bits(bits)))
            transform = np.concatenate([transform[bits == 0], transform[bits == 1]])
        # Where each word's block begins after the last level.
        self.begin = self._descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _sort(self) -> None:
        """Suffix places in order of their first ``DEPTH`` words, by doubling the sorted length."""
        n = len(self.text)
        rank = self.text.copy()
        self.ranks = {}
        size = 1
        while True:
            self.ranks[size] = rank
            if size >= DEPTH:
                break
            key = rank * (n + 2)
            key[:max(0, n - size)] += rank[size:] + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if n else 0
            rank, size = new, 2 * size
        self.suffixes = np.argsort(rank, kind="stable")

    def _descend(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(words >> level & 1, bits.zeros + ones, at - ones)
        return at

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step of many searches at once: intervals of word + pattern."""
        base = self.first[words] - self.begin[words]
        return base + self._descend(words, low), base + self._descend(words, high)

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of a pattern of fewer than ``DEPTH`` words."""
        low, high = np.zeros(1, np.int64), np.full(1, len(self.text), np.int64)
        for word in pattern[::-1]:
            if not 0 <= word < self.sigma:
                return 0
            low, high = self.extend(np.array([word]), low, high)
        return int(high[0] - low[0])

    def classes(self, size: int) -> np.ndarray:
        """Class number of every place in suffix order: equal where the first ``size`` words are (1 to ``DEPTH``)."""
        known = 1 << (size.bit_length() - 1)  # the longest doubled length that fits, laid over both ends
        rank, n = self.ranks[known], len(self.text)
        if not n:
            return np.zeros(0, np.int64)
        a, b = rank[self.suffixes], rank[np.minimum(self.suffixes + size - known, n - 1)]
        return np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))

    def matching_statistics(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every window of ``size`` words of every sequence, streamed right to left through the index.

        Returns (sequence, offset, low, high).  A search is extended by one word at a time; when
        it has ``size`` words, its last word is dropped first, by widening its interval to the
        suffixes that share one word less (the parent interval at depth ``size`` - 1).
        """
        if not 1 < size < DEPTH:
            raise ValueError(f"windows have 2 to {DEPTH - 1} words")
        shorter = self.classes(size - 1)
        edges = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1], [True]]))
        lengths = np.diff(self.starts) - 1
        live = np.argsort(-lengths, kind="stable")
        live = live[lengths[live] >= size]
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        out = []
        for step in range(int(lengths[live].max(initial=0))):
            running = int(np.searchsorted(-lengths[live], -step, side="left"))  # sequences longer than ``step``
            live, low, high = live[:running], low[:running], high[:running]
            if step >= size:
                group = shorter[low]
                low, high = edges[group], edges[group + 1]
            offset = lengths[live] - 1 - step
            low, high = self.extend(self.text[self.starts[live] + offset], low, high)
            if step >= size - 1:
                out.append((live, offset, low, high))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(column) for column in zip(*out))

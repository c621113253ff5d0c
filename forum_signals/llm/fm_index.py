"""A compressed FM-index over sequences of words: suffix order, Burrows-Wheeler transform, wavelet matrix, backward search.

Works on one bounded shard at a time, in numpy: bits are packed 64 to a word with one count per word, and all queries take
their steps together.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        size = len(bits) // 64 + 1
        padded = np.zeros(size * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, inside = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << inside) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask).astype(np.int64)


class WaveletMatrix:
    """Occurrences of a symbol before a position, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, BitRank(bits.astype(np.uint8)), zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.first = self._walk(np.arange(alphabet), np.zeros(alphabet, dtype=np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, rank, zeros in self.levels:
            ones = rank.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def occurrences(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._walk(symbols, at) - self.first[symbols]


def suffix_order(symbols: np.ndarray, longest: int) -> np.ndarray:
    """The suffixes in order. Symbol 0 ends a sequence; every end counts as different, in order of place.

    ``longest`` is the longest sequence: comparisons never go beyond an end, so doubling stops there.
    """
    n, ends = len(symbols), int((symbols == 0).sum())
    rank = symbols.astype(np.int64) + ends
    rank[symbols == 0] = np.arange(ends)
    order, width = np.argsort(rank), 1  # equal ones need no order of their own: in the end there are none
    while width <= longest:
        after = np.zeros(n, dtype=np.int64)
        after[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + ends + int(symbols.max(initial=0)) + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if n and fresh[-1] == n - 1:
            break
        width *= 2
    return order


class FMIndex:
    """Index of sequences of symbols 1 .. alphabet - 1, each followed by a 0."""

    def __init__(self, symbols: np.ndarray, alphabet: int, longest: int):
        self.order = suffix_order(symbols, longest)
        self.wavelet = WaveletMatrix(symbols[self.order - 1], alphabet)
        counts = np.bincount(symbols, minlength=alphabet)
        self.smaller = np.cumsum(counts) - counts

    def places(self) -> np.ndarray:
        """Where the suffix of each position stands in the order."""
        places = np.empty(len(self.order), dtype=np.int64)
        places[self.order] = np.arange(len(self.order))
        return places

    def search(self, patterns: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of equally long patterns (one per row), found from their last symbols backwards.

        ``own`` gives the place in the order of one occurrence of each pattern, if they are all known to occur: once an interval
        holds a single suffix, the pattern's only occurrence is that one, and it needs no more steps.
        """
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.order), dtype=np.int64)
        live, first, last = np.arange(len(patterns)), low.copy(), high.copy()
        for place in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, place]
            first = self.smaller[symbol] + self.wavelet.occurrences(symbol, first)
            last = self.smaller[symbol] + self.wavelet.occurrences(symbol, last)
            if own is not None:
                single = last - first == 1
                known = live[single]
                low[known], high[known] = own[known], own[known] + 1
                live, first, last = live[~single], first[~single], last[~single]
        low[live], high[live] = first, last
        return low, high

    def matching_statistics(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """For every end position of a streamed sequence the length, up to ``most``, of the longest match that ends there.

        Symbols that the index does not know are given as 0 and match nothing.
        """
        best = np.zeros(len(symbols), dtype=np.int64)
        at = np.arange(len(symbols))
        low, high = np.zeros(len(symbols), dtype=np.int64), np.full(len(symbols), len(self.order), dtype=np.int64)
        for length in range(1, most + 1):
            at = at[at - (length - 1) >= 0] if length > 1 else at
            low, high = low[-len(at) :] if len(at) else low[:0], high[-len(at) :] if len(at) else high[:0]
            symbol = symbols[at - (length - 1)]
            low = self.smaller[symbol] + self.wavelet.occurrences(symbol, low)
            high = self.smaller[symbol] + self.wavelet.occurrences(symbol, high)
            found = (high > low) & (symbol > 0)
            low, high = np.where(found, low, 0), np.where(found, high, 0)
            best[at[found]] = length
        return best

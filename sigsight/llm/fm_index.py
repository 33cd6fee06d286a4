"""A compressed FM-index over word sequences: wavelet matrix, counts and LCP intervals.

The index holds several sequences, each closed by a separator that compares
below every word and equal to any other separator; nothing is matched across
one.  The text and the suffix array are dropped after building; what stays is
the Burrows-Wheeler transform as one bit vector with rank counts per level, the
LCP array with the neighbours that give parent intervals, and the running sum
of the sequences' weights in suffix order.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


class WaveletMatrix:
    """Rank over a sequence of small integers, a bit vector a level, highest bit first."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.bits, self.counts, self.zeros = [], [], []
        for shift in range(levels - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, dtype=np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.levels = levels

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the first ``place`` elements' occurrences of the symbol end in the lowest level's order."""
        for level in range(self.levels):
            at = places >> 6
            below = self.bits[level][at] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[level][at] + np.bitwise_count(below)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            places = np.where(bit == 1, ones + self.zeros[level], places - ones)
        return places


class FMIndex:
    """Backward search and matching statistics over weighted sequences of symbols 1, 2, ..."""

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        """``sequences``: the symbols one after another, without separators."""
        n = len(sequences) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        text[inner] = sequences
        end = np.repeat(ends, lengths + 1)
        ranks = _prefix_ranks(text, end, int(lengths.max(initial=0)))
        suffixes = np.argsort(ranks[-1], kind="stable")
        self.lcp = _shared_prefixes(suffixes, end, ranks[:-1])
        self.before, self.after = _smaller_neighbours(self.lcp)
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, lengths + 1)[suffixes])])
        self.n = n
        levels = max(1, int(text.max(initial=0)).bit_length())
        transform = text[suffixes - 1]
        self.matrix = WaveletMatrix(transform, levels)
        symbols = np.arange(int(text.max(initial=0)) + 1)
        smaller = np.concatenate([[0], np.cumsum(np.bincount(text))[:-1]])
        self.shift = smaller - self.matrix.descend(symbols, np.zeros(len(symbols), dtype=np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the suffix intervals of the symbol followed by what the intervals stand for."""
        both = self.matrix.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.shift[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the next shorter prefix that occurs elsewhere too, and that prefix's length."""
        at = np.where(self.lcp[low] >= self.lcp[high], low, high)
        return self.before[at], self.after[at], self.lcp[at]

    def matching_statistics(self, sequences: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int) -> np.ndarray:
        """For every position of the streamed sequences the longest match from there on of weight ``least`` or more.

        All streams step from right to left together; a stream whose match can't
        be extended gives up its right end, parent by parent, until it can.
        """
        out = np.zeros(int(lengths.sum()), dtype=np.int32)
        to = np.cumsum(lengths) - lengths
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.n, dtype=np.int64)
        length = np.zeros(len(starts), dtype=np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            left = np.flatnonzero(lengths >= step)
            place = lengths - step
            while len(left):
                symbols = sequences[starts[left] + place[left]]
                new_low, new_high = self.extend(symbols, low[left], high[left])
                grown = self.weight[new_high] - self.weight[new_low] >= least
                done = left[grown]
                low[done], high[done] = new_low[grown], new_high[grown]
                length[done] += 1
                left = left[~grown]
                left = left[length[left] > 0]
                low[left], high[left], length[left] = self.parent(low[left], high[left])
            now = np.flatnonzero(lengths >= step)
            out[to[now] + place[now]] = length[now]
        return out


def _prefix_ranks(text: np.ndarray, end: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... symbols, until those reach the longest sequence."""
    ranks = [text.astype(np.int32)]
    place, width = np.arange(len(text)), 1
    while width <= longest:
        last = ranks[-1].astype(np.int64)
        pairs = last * (len(text) + 1) + last[np.minimum(place + width, end)]
        ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return ranks


def _shared_prefixes(suffixes: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """lcp[i]: symbols that suffix i shares with the one before it; -1 at both ends."""
    one, other = suffixes[:-1].copy(), suffixes[1:].copy()
    shared = np.zeros(len(one), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][one] == ranks[k][other]
        shared += same << k
        one, other = (np.where(same, np.minimum(x + (1 << k), end[x]), x) for x in (one, other))
    room = end[suffixes] - suffixes
    shared = np.minimum(shared, np.minimum(room[:-1], room[1:]))
    return np.concatenate([[-1], shared, [-1]])


def _smaller_neighbours(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest ones before and after it with a smaller value, level by level."""
    before, after = np.zeros(len(lcp), dtype=np.int64), np.full(len(lcp), len(lcp) - 1, dtype=np.int64)
    order = np.argsort(lcp, kind="stable")
    values = lcp[order]
    for depth in range(int(lcp.max(initial=-1)) + 1):
        low, high = np.searchsorted(values, [depth, depth + 1])
        if low == high:
            continue
        smaller = np.flatnonzero(lcp < depth)
        here = order[low:high]
        turn = np.searchsorted(smaller, here)
        before[here], after[here] = smaller[turn - 1], smaller[turn]
    return before, after

"""A compressed full-text index of numbers: Burrows-Wheeler transform, wavelet tree, backward
search for many queries at once.

The transform is kept as a wavelet tree in matrix form: one bit vector for each bit of the
symbols, packed, with the ones before every 64-bit word counted. A symbol takes its bits
and half as many again; nothing else of the text is kept but one number for each place.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` ordered by their first ``depth`` symbols at least, by prefix
    doubling; equal ones in the order of their places."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    order = np.argsort(rank, kind="stable")
    while n and width < depth:
        behind = np.zeros(n, dtype=np.int64)
        behind[:-width] = rank[width:] + 1
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        width *= 2
    return order


class Bits:
    """A packed bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype="<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletTree:
    """Counts how often a symbol stands before a place of a sequence."""

    def __init__(self, symbols: np.ndarray):
        self.height = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.levels: list[Bits] = []
        for k in reversed(range(self.height)):
            bits = (symbols >> k) & 1 == 1
            self.levels.append(Bits(bits))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, places: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """For each array of places, how often ``symbol`` stands before them."""
        start, out = np.zeros(len(symbol), dtype=np.int64), list(places)
        for k, level in zip(reversed(range(self.height)), self.levels):
            one = (symbol >> k) & 1 == 1
            moved = [(p, level.ones(p)) for p in (start, *out)]
            start, *out = [np.where(one, level.zeros + ones, p - ones) for p, ones in moved]
        return [p - start for p in out]


class FMIndex:
    """Index of a text of small numbers. 0 separates and is the last symbol; it is in no
    pattern. Suffixes are ordered by their first ``depth`` symbols at least, so patterns of
    up to ``depth`` symbols are found."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = text
        self.order = suffix_order(text, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        # The symbol in front of every row's suffix; the whole text counts as after a 0.
        self.tree = WaveletTree(text[self.order - 1])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: of the rows in ``[low, high)`` those with ``symbol``
        in front, as the range of rows that begin with it."""
        a, b = self.tree.rank(symbol, (low, high))
        return self.first[symbol] + a, self.first[symbol] + b

    def matching_statistics(self, ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high) for each of the places ``ends`` of a streamed text that is part
        of the indexed one: how many symbols before it, ``cap`` at most, stand elsewhere too,
        and the rows of that match. As the stream matches itself, a match is two rows or more."""
        length = np.zeros(len(ends), dtype=np.int64)
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(self.text), dtype=np.int64)
        live = np.arange(len(ends))
        for k in range(cap):
            symbol = self.text[ends[live] - 1 - k]  # place -1 is the separator at the end
            live, symbol = live[symbol > 0], symbol[symbol > 0]
            a, b = self.extend(symbol, low[live], high[live]) if k else (self.first[symbol], self.first[symbol + 1])
            again = b - a > 1
            live, a, b = live[again], a[again], b[again]
            if not len(live):
                break
            length[live], low[live], high[live] = k + 1, a, b
        return length, low, high

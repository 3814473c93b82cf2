"""FM-index over a sequence of integer symbols: suffix order, wavelet matrix, sampled positions.

Symbol 0 separates runs and never matches. Patterns are searched backwards, all at
once; occurrences are located by walking to the nearest sampled suffix.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each separator is smaller than any symbol and unique."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (int(rank.max()) + 2 if n else 1) + after
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        sorted_key = key[order]
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        width *= 2


class WaveletMatrix:
    """Rank and access over integers below 2**bits."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.set, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.set.append(bit.astype(bool))
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbols: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol occurs before each of the ends."""
        at = [np.zeros(len(symbols), np.int64), *ends]
        for i in range(self.bits):
            bit = ((symbols >> (self.bits - 1 - i)) & 1).astype(bool)
            ones = [self.ones[i][x] for x in at]
            at = [np.where(bit, self.zeros[i] + o, x - o) for x, o in zip(at, ones)]
        return [x - at[0] for x in at[1:]]

    def access(self, rows: np.ndarray) -> np.ndarray:
        at, symbols = rows, np.zeros(len(rows), np.int64)
        for i in range(self.bits):
            bit, ones = self.set[i][at], self.ones[i][at]
            symbols = symbols * 2 + bit
            at = np.where(bit, self.zeros[i] + ones, at - ones)
        return symbols


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = 16):
        """``text``: int64 symbols, 0 between and after runs."""
        order = suffix_array(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.bwt = WaveletMatrix(before)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text))))
        # A row is sampled at every sample-th position and where a run starts, so a walk never leaves its run.
        self.sampled = (order % sample == 0) | (before == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns; ``patterns`` is right-aligned, padded on the left."""
        n, width = patterns.shape
        low, high = np.zeros(n, np.int64), np.full(n, len(self.sampled), np.int64)
        top = len(self.first) - 1
        for j in range(width):
            live = np.flatnonzero((lengths > j) & (low < high))
            if not len(live):
                break
            symbol = patterns[live, width - 1 - j]
            known = (symbol > 0) & (symbol < top)
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            a, b = self.bwt.rank(symbol, low[live], high[live])
            low[live], high[live] = self.first[symbol] + a, self.first[symbol] + b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in ``rows``."""
        out, steps, todo, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.sample_rank[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                symbols = self.bwt.access(at)
                at = self.first[symbols] + self.bwt.rank(symbols, at)[0]
                steps += 1
        return out

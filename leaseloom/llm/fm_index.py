"""An FM-index over a sequence of word numbers: backward search through wavelet-matrix ranks, places by sampled suffixes."""

from __future__ import annotations

import numpy as np

from leaseloom.llm.suffix_array import suffix_array
from leaseloom.llm.text_arrays import ranges

#: Every so many places of the sequence, the suffix's place in the order is kept.
SAMPLE_STEP = 8


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int):
        """`symbols`: numbers from 0 to size - 1. A last symbol below all of them is added."""
        s = np.append(symbols.astype(np.int64) + 1, 0)
        n = self.n = len(s)
        self.levels = max(1, int(size + 1).bit_length())
        padded = np.concatenate([s, np.zeros(3, np.int64)])
        at_once = max(1, min(4, 63 // self.levels))
        keys = np.zeros(n, np.uint64)
        for j in range(at_once):
            keys = (keys << np.uint64(self.levels)) | padded[j:j + n].astype(np.uint64)
        order, _ = suffix_array(keys, at_once)
        last = s[order - 1]  # the symbol before each suffix
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=size + 2))])
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.last = last
        row = last
        for level in range(self.levels - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(self.ones[-1][-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.sampled = order % SAMPLE_STEP == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `upto` places of the transformed sequence."""
        low, high = np.zeros(len(symbol), np.int64), upto.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k]
            one = (symbol >> level) & 1 == 1
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, self.zeros[k] + low_ones, low - low_ones)
            high = np.where(one, self.zeros[k] + high_ones, high - high_ones)
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each pattern, a row of numbers; -1 after the end of a shorter one."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            here = live[symbol >= 0]
            symbol = symbol[symbol >= 0] + 1
            low[here] = self.below[symbol] + self.rank(symbol, low[here])
            high[here] = self.below[symbol] + self.rank(symbol, high[here])
            live = live[low[live] < high[live]]
        return low, np.maximum(high, low)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of each interval: the interval's number and the place."""
        counts = high - low
        which, row = np.repeat(np.arange(len(low)), counts), ranges(low, counts)
        place = np.zeros(len(row), np.int64)
        live, walked = np.arange(len(row)), 0
        while len(live):
            found = self.sampled[row[live]]
            done = live[found]
            place[done] = self.samples[self.sample_rank[row[done]]] + walked
            live = live[~found]
            symbol = self.last[row[live]]
            row[live] = self.below[symbol] + self.rank(symbol, row[live])
            walked += 1
        return which, place

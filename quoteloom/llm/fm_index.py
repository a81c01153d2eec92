"""FM-index over a shard of words: suffix order, wavelet-matrix ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = first[np.cumsum(new) - 1]
    k = 1
    while True:
        size = np.diff(np.append(first, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        slots = np.flatnonzero(tied)
        who = order[slots]
        after = np.where(who + k < n, rank[np.minimum(who + k, n - 1)], -1)
        key = rank[who] * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[slots] = who
        new[slots[1:]] |= key[1:] != key[:-1]
        first = np.flatnonzero(new)
        rank[order] = first[np.cumsum(new) - 1]
        k *= 2


class Wavelet:
    """Wavelet matrix: how often a symbol occurs before a place, for many symbols and places at once."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = []
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(bool)
            zeros = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(~bit, out=zeros[1:])
            self.levels.append((shift, zeros, int(zeros[-1])))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for shift, zeros, total in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            zs, zp = zeros[start], zeros[place]
            start = np.where(one, total + start - zs, zs)
            place = np.where(one, total + place - zp, zp)
        return place - start


class FMIndex:
    """Index of runs of words, given as one array of word numbers and each run's length.

    Runs end in separators that all differ, so that no match and no tie crosses
    a run.  Word numbers are 0 to ``words`` - 1.
    """

    def __init__(self, numbers: np.ndarray, run_lengths: np.ndarray, words: int):
        runs = len(run_lengths)
        ends = np.cumsum(run_lengths + 1)
        self.size = int(ends[-1]) if runs else 0
        text = np.empty(self.size, np.int64)
        is_end = np.zeros(self.size, bool)
        is_end[ends - 1] = True
        text[ends - 1] = np.arange(runs)
        text[~is_end] = numbers + runs
        order = suffix_order(text)
        flat = np.where(is_end, 0, text - runs + 1)  # all separators are symbol 0 from here on
        self.last = flat[order - 1]  # the symbol before each suffix
        self.wavelet = Wavelet(self.last, words + 1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=words + 1))])
        starts = np.concatenate([[0], ends[:-1]]) if runs else np.zeros(0, np.int64)
        sampled = order % SAMPLE == 0
        at_start = np.zeros(self.size, bool)
        at_start[starts] = True  # the walk back never meets a separator
        sampled |= at_start[order]
        self.kept = np.cumsum(sampled) - 1
        self.sampled, self.positions = sampled, order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, one a row, right-aligned; empty where a phrase is absent."""
        width = phrases.shape[1]
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(step < lengths[live]) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, width - 1 - step] + 1
            low[live] = self.below[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.below[symbol] + self.wavelet.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to sampled ones."""
        out = np.empty(len(rows), np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.positions[self.kept[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol = self.last[at]
            at = self.below[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out

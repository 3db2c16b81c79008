"""An FM-index over integer sequences with numpy: suffix array, wavelet matrix, backward search, sampled locating."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for count values, for each pair."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence that ends with its unique least symbol, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = fresh
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Bits:
    """A bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        raw = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        raw[: len(packed)] = packed
        self.words = raw.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """rank(symbols, positions): occurrences of each symbol before each position."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[Bits] = []
        self.zeros: list[int] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(Bits(bit))
            now, ones = now[bit == 0], now[bit == 1]
            self.zeros.append(len(now))
            now = np.concatenate((now, ones))

    def rank(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        base, at = np.zeros(len(symbols), np.int64), positions.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            a, b = ones.rank(base), ones.rank(at)
            base, at = np.where(bit, zeros + a, base - a), np.where(bit, zeros + b, at - b)
        return at - base

    def here(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before."""
        symbol, base, at = np.zeros(len(positions), np.int64), np.zeros(len(positions), np.int64), positions.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones.get(at)
            a, b = ones.rank(base), ones.rank(at)
            base, at = np.where(bit, zeros + a, base - a), np.where(bit, zeros + b, at - b)
            symbol = 2 * symbol + bit
        return symbol, at - base


class FMIndex:
    """Index of one shard, about six bytes a symbol. Symbols are integers from 1; 0 is added as the end."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.wavelet = WaveletMatrix(text[order - 1], size)
        marked = order % SAMPLE == 0
        self.marked, self.samples, self.n = Bits(marked), order[marked].astype(np.int32), len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of left-aligned phrases: indices of those that occur, and their rows [low, high)."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            at = lengths[alive] - 1 - back
            moving = at >= 0
            who = alive[moving]
            c = phrases[who, at[moving]].astype(np.int64)
            low[who] = self.first[c] + self.wavelet.rank(c, low[who])
            high[who] = self.first[c] + self.wavelet.rank(c, high[who])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix rows, by steps back to the nearest sampled suffix."""
        where, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        steps = 0
        while len(left):
            done = self.marked.get(where[left])
            hit = left[done]
            out[hit] = self.samples[self.marked.rank(where[hit])] + steps
            left = left[~done]
            symbol, before = self.wavelet.here(where[left])
            where[left] = self.first[symbol] + before
            steps += 1
        return out

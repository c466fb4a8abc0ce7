"""Elias-Fano sequences and the n-gram trie that language-model scoring asks.

Level 1 holds the contexts' last words (sorted hashes) with their exact counts. Below it stand three levels, each
a sequence of symbols sorted inside their parents: the successors of a word, the words before it (with which it
is a context of two words), and the successors of these longer contexts. A level keeps, Elias-Fano coded, a
monotone pointer from each parent to its first symbol, and all symbols as one monotone sequence (the
parent's number in front of the symbol), beside one byte for each symbol: the quantised discounted
probability of a successor, or the quantised back-off weight of a context. A symbol is searched for between its
parent's pointers. All arrays of a sequence lie in one memory map.
"""

from __future__ import annotations

import mmap
from collections.abc import Callable

import numpy as np

#: Quantised -log10 probabilities: STEP apart, NONE for what was never seen.
STEP, NONE = 0.04, 255
#: _SELECT[b << 3 | k]: the place of byte b's k-th set bit, lowest first.
_SELECT = np.array([[*(i for i in range(8) if b >> i & 1), *[0] * 8][:8] for b in range(256)], np.int64).reshape(-1)
_L, _H = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_ODD, _PAIR, _NIBBLE = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word's k-th set bit, lowest first."""
    s = word - (word >> np.uint64(1) & _ODD)
    s = (s & _PAIR) + (s >> np.uint64(2) & _PAIR)
    s = (s + (s >> np.uint64(4)) & _NIBBLE) * _L  # ones in each byte and those below it
    k = k.astype(np.uint64)
    byte = np.bitwise_count((k * _L | _H) - s & _H).astype(np.uint64) << np.uint64(3)  # bytes passed
    k -= (s << np.uint64(8)) >> byte & np.uint64(255)
    return byte.astype(np.int64) + _SELECT[((word >> byte & np.uint64(255)) << np.uint64(3) | k).astype(np.int64)]


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays, copied into one anonymous memory map."""
    room = mmap.mmap(-1, max(1, sum(a.nbytes + 8 for a in arrays)))
    out, at = [], 0
    for a in arrays:
        view = np.frombuffer(room, a.dtype, len(a), at)
        view[:] = a
        out.append(view)
        at += -(-a.nbytes // 8) * 8
    return out


def _words(places: np.ndarray, bits: int) -> np.ndarray:
    """A bit vector of `bits` bits with ones at the places, as 64-bit words."""
    b = np.zeros((bits // 64 + 1) * 64, np.uint8)
    b[places] = 1
    return np.packbits(b, bitorder="little").view(np.uint64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with a directory of ones by word.

    `low_bits` is the number of low bits, by default the one that takes the least room.
    """

    def __init__(self, values: np.ndarray, universe: int, low_bits: int | None = None):
        n = len(values)
        self.n = n
        self.l = max(0, int(universe // max(n, 1)).bit_length() - 1) if low_bits is None else low_bits
        v = values.astype(np.uint64)
        high = (v >> np.uint64(self.l)).astype(np.int64)
        upper = _words(high + np.arange(n), n + (universe >> self.l) + 1)
        if self.l:
            low, at = v & np.uint64((1 << self.l) - 1), np.arange(n) * self.l
            w, o = at >> 6, (at & 63).astype(np.uint64)
            lower = np.zeros(n * self.l // 64 + 2, np.uint64)
            if n:  # no two values share a bit, so adding is setting
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                lower[w[first]] = np.add.reduceat(low << o, first)
                over = np.flatnonzero(o + np.uint64(self.l) > 64)
                lower[w[over] + 1] += low[over] >> (np.uint64(64) - o[over])
        else:
            lower = np.zeros(1, np.uint64)
        ones = np.bitwise_count(upper).astype(np.int64)
        before = np.cumsum(ones) - ones
        self.upper, self.lower, self.before, self.zeros = mapped(upper, lower, before, np.arange(len(upper), dtype=np.int64) * 64 - before)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        w, o = at >> 6, (at & 63).astype(np.uint64)
        first = self.lower[w] >> o
        second = np.where(o > 0, self.lower[w + 1] << (np.uint64(64) - np.maximum(o, np.uint64(1))), np.uint64(0))
        return (first | second) & np.uint64((1 << self.l) - 1)

    def _select(self, k: np.ndarray, directory: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (zero if flip) of the upper bits."""
        w = np.searchsorted(directory, k, "right") - 1
        word = self.upper[w]
        return w * 64 + select_in_word(~word if flip else word, k - directory[w])

    def access(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, self.before, False) - i
        return high.astype(np.uint64) << np.uint64(self.l) | self.low(i)

    def next_geq(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that is not below x, and whether it is x."""
        high = (x >> np.uint64(self.l)).astype(np.int64)
        low = x & np.uint64((1 << self.l) - 1) if self.l else np.zeros(len(x), np.uint64)
        stop = self._select(high, self.zeros, True) - high
        at = np.where(high > 0, self._select(np.maximum(high - 1, 0), self.zeros, True) + 1 - high, 0)
        at = _least(at, stop, lambda mid, some: self.low(mid) < low[some])
        hit = np.zeros(len(x), bool)
        some = np.flatnonzero(at < stop)
        hit[some] = self.low(at[some]) == low[some]
        return at, hit


def _least(begin: np.ndarray, end: np.ndarray, below: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place of each range [begin, end) that isn't below what is searched for, by halving all ranges at once."""
    at, last = begin.copy(), end.copy()
    open_ = np.flatnonzero(at < last)
    while open_.size:
        mid = (at[open_] + last[open_]) >> 1
        less = below(mid, open_)
        at[open_[less]] = mid[less] + 1
        last[open_[~less]] = mid[~less]
        open_ = open_[at[open_] < last[open_]]
    return at


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(np.maximum(p, 1e-300)) / STEP), NONE - 1).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    """Probabilities of quantised codes; 0 for NONE."""
    return _RESTORED[codes]


_RESTORED = np.r_[10.0 ** (-STEP * np.arange(NONE)), 0.0]


class Level:
    """Symbols (below 2**32) sorted inside their parents, with one code each.

    A key's high part is its parent and its low part the symbol, so between a parent's pointers only low parts are compared.
    """

    def __init__(self, parents: int, parent: np.ndarray, symbol: np.ndarray, codes: np.ndarray):
        """(parent, symbol) pairs in order and without repeats."""
        self.pointers = EliasFano(np.searchsorted(parent, np.arange(parents + 1)), len(parent) + 1)
        self.keys = EliasFano(parent.astype(np.uint64) << np.uint64(32) | symbol.astype(np.uint64), max(1, parents) << 32, 32)
        self.symbols = self.keys.lower.view(np.uint32)
        (self.codes,) = mapped(codes)

    def find(self, parent: np.ndarray, symbol: np.ndarray, repeat: np.ndarray | None = None) -> np.ndarray:
        """The places of symbols below parents, -1 if there is none. `repeat`: symbols asked for each parent, one after another."""
        known = np.flatnonzero(parent >= 0)
        begin, end = np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
        some = parent[known]
        begin[known], end[known] = self.pointers.access(some).astype(np.int64), self.pointers.access(some + 1).astype(np.int64)
        if repeat is not None:
            begin, end = np.repeat(begin, repeat), np.repeat(end, repeat)
        symbol = symbol.astype(np.uint32)
        at = _least(begin, end, lambda mid, some: self.symbols[mid] < symbol[some])
        some = np.flatnonzero(at < end)
        out = np.full(len(at), -1)
        hit = some[self.symbols[at[some]] == symbol[some]]
        out[hit] = at[hit]
        return out

    def code(self, place: np.ndarray) -> np.ndarray:
        """The codes at places; NONE where a place is -1."""
        if not len(self.codes):
            return np.full(len(place), NONE, np.uint8)
        return np.where(place >= 0, self.codes[np.maximum(place, 0)], NONE).astype(np.uint8)


class Trie:
    """The levels of one shard, from its sorted tables without repeats and with counts above 0.

    pairs: (context number, successor, count); triples: (context number, word before, successor, count).
    counts: each context's count, which may go beyond the rows given. k2, k3: the discounts, in counts: a context
    of count c gives k / (c + k) of its probability to the shorter context.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, pairs: tuple, triples: tuple, k2: float, k3: float):
        self.contexts, self.counts = mapped(contexts, counts.astype(np.int64))
        of, symbol, count = pairs
        self.successors = Level(len(contexts), of, symbol, quantise(count / (counts[of] + k2)))
        of, before, symbol, count = triples
        first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (before[1:] != before[:-1])]) if len(of) else np.zeros(0, np.int64)
        total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        self.longer = Level(len(contexts), of[first], before[first], quantise(k3 / (total + k3)))
        node = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(of)]))
        self.after = Level(len(first), node, symbol, quantise(count / (total[node] + k3)))

    def context(self, h: np.ndarray) -> np.ndarray:
        """The number of each context word, -1 if it was never seen."""
        if not len(self.contexts):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.contexts, h), len(self.contexts) - 1)
        return np.where(self.contexts[i] == h, i, -1)

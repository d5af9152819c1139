"""A bigram trie in Elias-Fano levels.

Level 1 holds the contexts, ascending; a pointer level says where each context's children begin; the child
level holds the children as one ascending sequence: the context's rank, then the child. All three are
Elias-Fano sequences: low bits packed, high bits in unary. A child is found by successor search relative to its
context: the high part of (rank, child) bounds, by two selections in the unary bits, a short stretch in which low
parts are compared; the pointers of the context say whether what is found is a child of it. No level is unpacked:
a level is a run of bytes that is read in place, as it lies in a file, a map of it or an Arrow buffer.

Probabilities are 16-bit codes on a logarithmic scale, rounded down: of a pair's probability, times the number of
tokens the model was trained on.
"""

from __future__ import annotations

import numpy as np

STEPS = 1024  # codes for each factor of two
HALVES = [np.uint64(1 << k) for k in (5, 4, 3, 2, 1, 0)]
MASKS = [np.uint64((1 << (1 << k)) - 1) for k in (5, 4, 3, 2, 1, 0)]


class Bits:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.ones = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))
        self.zeros = 64 * np.arange(len(words) + 1) - self.ones

    def select(self, i: np.ndarray, one: bool) -> np.ndarray:
        """Place of the i-th one (or zero)."""
        before = self.ones if one else self.zeros
        at = np.searchsorted(before, i, "right") - 1
        rest = (i - before[at]).astype(np.uint64)
        word = self.words[at] if one else ~self.words[at]
        place = at.astype(np.int64) * 64
        for half, mask in zip(HALVES, MASKS, strict=True):
            count = np.bitwise_count(word & mask).astype(np.uint64)
            on = rest >= count
            rest -= np.where(on, count, np.uint64(0))
            word = np.where(on, word >> half, word & mask)
            place += np.where(on, np.int64(half), 0)
        return place


def whole_words(bits: np.ndarray) -> np.ndarray:
    """Bytes filled up to 64-bit words."""
    return np.append(bits, np.zeros(-len(bits) % 8 or 0, np.uint8))


class EliasFano:
    """An ascending sequence of numbers below 2 ** 63, over its bytes."""

    def __init__(self, data: bytes | memoryview) -> None:
        head = np.frombuffer(data, "<u8", 4)
        self.n, self.l, self.buckets, low = (int(x) for x in head)
        self.low = np.frombuffer(data, np.uint8, low, 32)
        self.high = Bits(np.frombuffer(data, "<u8", offset=32 + low))

    @staticmethod
    def packed(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        l = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        low, places, parts = values & np.uint64((1 << l) - 1), np.arange(l, dtype=np.uint64), []
        for a in range(0, n, 1 << 14):  # bits are spread out for a stretch of values at a time
            bits = ((low[a : a + (1 << 14), None] >> places) & np.uint64(1)).astype(np.uint8)
            parts.append(np.packbits(bits.ravel(), bitorder="little"))
        lows = whole_words(np.concatenate([*parts, np.zeros(8, np.uint8)]))
        high = (values >> np.uint64(l)).astype(np.int64)
        buckets = (int(high[-1]) if n else 0) + 1
        marks = np.zeros(buckets + n, np.uint8)  # a one for each value, a zero after each bucket of equal high parts
        marks[high + np.arange(n)] = 1
        highs = whole_words(np.packbits(marks, bitorder="little"))
        return np.array([n, l, buckets, len(lows)], "<u8").tobytes() + lows.tobytes() + highs.tobytes()

    def low_parts(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.int64) * self.l
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        return (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = (self.high.select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self.low_parts(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value not below each x (the length if there is none)."""
        want = (x >> np.uint64(self.l)).astype(np.int64)
        beyond = want >= self.buckets
        want = np.where(beyond, 0, want)
        start = np.where(want > 0, self.high.select(np.maximum(want - 1, 0), False) - want + 1, 0)
        end = self.high.select(want, False) - want
        low = x & np.uint64((1 << self.l) - 1)
        while (open_ := start < end).any():  # halving the stretches with equal high part
            i = np.flatnonzero(open_)
            mid = (start[i] + end[i]) // 2
            less = self.low_parts(mid) < low[i]
            start[i[less]] = mid[less] + 1
            end[i[~less]] = mid[~less]
        return np.where(beyond, self.n, start)


class BigramTrie:
    """Probabilities of bigrams, over the bytes of the four levels."""

    def __init__(self, data: bytes | memoryview) -> None:
        ends = np.cumsum(np.frombuffer(data, "<u8", 4)).astype(np.int64) + 32
        parts = [memoryview(data)[a:b] for a, b in zip([32, *ends], ends)]
        self.contexts, self.pointers, self.children = (EliasFano(p) for p in parts[:3])
        self.codes = np.frombuffer(parts[3], "<u2")

    @staticmethod
    def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
        """The bytes for keys (context and word as 32-bit numbers in one 64-bit number, ascending and distinct) and how often each was seen."""
        context, starts = np.unique(keys >> np.uint64(32), return_index=True)
        rank = np.repeat(np.arange(len(context), dtype=np.uint64), np.diff(np.append(starts, len(keys))))
        levels = [EliasFano.packed(x) for x in (context, np.append(starts, len(keys)).astype(np.uint64), (rank << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF)))]
        levels.append(whole_words((1 + np.floor(np.log2(counts) * STEPS)).astype("<u2").view(np.uint8)).tobytes())
        return np.array([len(x) for x in levels], "<u8").tobytes() + b"".join(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, 0 if it is not there."""
        out = np.zeros(len(keys), np.uint16)
        if not self.children.n or not len(keys):
            return out
        context, turn = np.unique(keys >> np.uint64(32), return_inverse=True)
        rank = self.contexts.successor(context)
        there = rank < self.contexts.n
        there[there] = self.contexts.values(rank[there]) == context[there]
        first, last = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        first[there], last[there] = self.pointers.values(rank[there]), self.pointers.values(rank[there] + 1)
        known = np.flatnonzero(there[turn])
        of = turn[known]
        child = (rank[of].astype(np.uint64) << np.uint64(32)) | (keys[known] & np.uint64(0xFFFFFFFF))
        at = self.children.successor(child)
        inside = (at >= first[of]) & (at < last[of])  # among the context's own children
        at, known, child = at[inside], known[inside], child[inside]
        same = self.children.values(at) == child
        out[known[same]] = self.codes[at[same]]
        return out


def counts_of(codes: np.ndarray) -> np.ndarray:
    """What codes stand for (0 for 0), at most one part in a thousand too low."""
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 1) / STEPS), 0.0)

"""Elias-Fano coding of monotone integers, read from a buffer.

``n`` values below ``universe`` are split: the low bits are packed, the high
parts are written in unary (one set bit a value, one clear bit a step), about
two bits each. Small directories of set bits per 64-bit word find the k-th
set or clear bit. All readers take arrays of positions.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 18  # values coded at once
_COUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)
#: Place of the r-th set bit in a byte; by rule, not by hand.
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [8] * 8)[:8] for i in range(256)], dtype=np.int64)


def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit of each 64-bit word."""
    b = words.astype("<u8").view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_COUNT[b], axis=1)
    k = (upto <= r[:, None]).sum(axis=1)
    at = np.arange(len(r))
    before = np.where(k > 0, upto[at, np.maximum(k - 1, 0)], 0)
    return 8 * k + _PLACE[b[at, np.minimum(k, 7)], np.minimum(r - before, 7)]


def encode(values: np.ndarray, universe: int) -> bytes:
    """Nondecreasing ``values`` (each below ``universe``) as bytes."""
    v = np.asarray(values)
    n = len(v)
    low = min(60, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
    steps = int(universe - 1 >> low) + 1 if universe > 0 else 1
    bits = np.zeros(-(-(n + steps + 1) // 64) * 64, dtype=np.uint8)
    lower = np.zeros(-(-(n * low) // 64) + 1, dtype=np.uint64)
    for i in range(0, n, SLICE):  # the whole would need several copies
        part = v[i : i + SLICE].astype(np.uint64)
        place = np.arange(i, i + len(part), dtype=np.int64)
        bits[(part >> np.uint64(low)).astype(np.int64) + place] = 1
        if low:
            rest = part & np.uint64((1 << low) - 1)
            at = place.astype(np.uint64) * np.uint64(low)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(lower, word, rest << shift)
            over = shift + np.uint64(low) > np.uint64(64)
            np.bitwise_or.at(lower, word[over] + 1, rest[over] >> (np.uint64(64) - shift[over]))
    upper = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(_COUNT[upper.view(np.uint8).reshape(-1, 8)].sum(axis=1))]).astype("<u4")
    head = np.array([n, low, steps, len(upper), len(lower)], dtype="<u8")
    pad = b"\0" * (-(4 * len(ones)) % 8)
    return head.tobytes() + upper.tobytes() + ones.tobytes() + pad + lower.astype("<u8").tobytes()


class EliasFano:
    """A view of encoded values in ``buffer`` from ``start``; ``end`` is where it stops."""

    def __init__(self, buffer, start: int = 0):
        n, self.low, self.steps, u, w = (int(x) for x in np.frombuffer(buffer, "<u8", 5, start))
        self.n, at = n, start + 40
        self.upper = np.frombuffer(buffer, "<u8", u, at)
        at += 8 * u
        self.ones = np.frombuffer(buffer, "<u4", u + 1, at)
        at += 4 * (u + 1) + (-(4 * (u + 1)) % 8)
        self.lower = np.frombuffer(buffer, "<u8", w, at)
        self.end, self.parts = at + 8 * w, None

    def _rest(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        more = np.where(shift > 0, self.lower[np.minimum(word + 1, len(self.lower) - 1)] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return ((self.lower[word] >> shift) | more) & np.uint64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values (unsigned)."""
        i = np.asarray(i, dtype=np.int64)
        w = np.searchsorted(self.ones, i, side="right") - 1
        place = 64 * w + _in_word(self.upper[w], i - self.ones[w])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self._rest(i)

    def _starts(self) -> np.ndarray:
        """Index of the first value of each high part, and n at the end. The
        unary part read once, for many searches; not part of the coding."""
        if self.parts is None:
            bits = np.unpackbits(self.upper.view(np.uint8), bitorder="little")[: self.n + self.steps + 1]
            zeros = np.flatnonzero(bits == 0)[: self.steps]
            self.parts = np.append(0, zeros - np.arange(len(zeros))).astype(np.uint32 if self.n < 1 << 32 else np.int64)
        return self.parts

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if there is none)."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value equal to x, -1 where there is none."""
        at, inside, want = self._search(x)
        at[~inside] = -1
        some = np.flatnonzero(inside)
        at[some[self._rest(at[some]) != want[some]]] = -1
        return at

    def _search(self, x: np.ndarray):
        """(successor's index, whether its high part is that of x, low bits of x)."""
        x, part = np.asarray(x, dtype=np.uint64), self._starts()
        h = np.minimum(x >> np.uint64(self.low), np.uint64(self.steps)).astype(np.int64)
        lo, top = part[h].astype(np.int64), part[np.minimum(h + 1, self.steps)].astype(np.int64)
        want = x & np.uint64((1 << self.low) - 1)
        hi = top.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # halves the few values that share the high part
            mid = lo[open_] + hi[open_] >> 1
            less = self._rest(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, lo < top, want

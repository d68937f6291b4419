"""Elias-Fano sequences: sorted integers in about ``2 + log2(universe / n)`` bits each.

The low bits of each value are packed, the high bits are a unary bit vector.  All operations
take numpy arrays of questions.  ``to_bytes`` gives one flat image; ``from_buffer`` works on
it in place, so it may be a memory map.  The popcount directory is made when opened.
"""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Position of the k-th one of each byte, from the least bit.
_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)

#: Values to a question up to which the values between the questions are decoded in one pass.
RUN = 4


class EliasFano:
    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = _POP[high.reshape(-1, 8)].sum(1, dtype=np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))
        self.zeros = 64 * np.arange(len(self.ones)) - self.ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        """A sequence of ascending values below ``universe``."""
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if universe is None and n else universe or 1
        width = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        bits = np.zeros(-(-(n + (universe >> width) + 2) // 64) * 64, bool)
        bits[(values >> width) + np.arange(n)] = True
        step = 1 << 14  # a multiple of eight, so each piece ends at a byte
        low = [np.packbits((values[a : a + step, None] >> np.arange(width) & 1).astype(bool).reshape(-1), bitorder="little") for a in range(0, n, step)]
        return cls(n, width, np.concatenate((*low, np.zeros(8, np.uint8))), np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.width, len(self.low), len(self.high)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_buffer(cls, buffer, at: int = 0) -> tuple[EliasFano, int]:
        """(the sequence whose image begins at ``at``, where it ends)."""
        n, width, low, high = np.frombuffer(buffer, np.int64, 4, at).tolist()
        at += 32
        return cls(n, width, np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low)), at + low + high

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: int) -> np.ndarray:
        word = np.searchsorted(counts, k, "right") - 1
        rest = k - counts[word]
        eight = self.high.reshape(-1, 8)[word] ^ np.uint8(flip)
        ends = np.cumsum(_POP[eight], 1, dtype=np.int64)
        byte = (ends <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        rest = rest - np.where(byte > 0, ends[row, byte - 1], 0)
        return 64 * word + 8 * byte + _SELECT[eight[row, byte], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        at, out = bit >> 3, np.zeros(len(i), np.int64)
        for k in range((self.width + 14) // 8):
            out |= self.low[at + k].astype(np.int64) << (8 * k)
        return (out >> (bit & 7)) & ((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at positions ``i``."""
        i = np.asarray(i, np.int64)
        if len(i):
            a, b = int(i.min()), int(i.max()) + 1
            if b - a <= RUN * len(i):
                return self.values(a, b)[i - a]
        return self._at(i)

    def _at(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, self.ones, 0) - i << self.width) | self._low(i)

    def values(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """The values at positions from ``a`` to before ``b``, by one pass over their bits."""
        b = self.n if b is None else b
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = self._select(np.array([a, b - 1]), self.ones, 0).tolist()
        byte = first >> 3
        bits = np.unpackbits(self.high[byte : (last >> 3) + 1], bitorder="little")
        out = np.flatnonzero(bits[first & 7 : last + 1 - 8 * byte])
        out += first - np.arange(a, b)
        out <<= self.width
        for k in range(a, b, 1 << 16):
            end = min(b, k + (1 << 16))
            out[k - a : end - a] |= self._low(np.arange(k, end))
        return out

    def _search(self, x: np.ndarray) -> np.ndarray:
        """``successor`` in place, by select."""
        top = x >> self.width
        hi = self._select(top, self.zeros, 255) - top
        lo = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, 255) - (top - 1), 0)
        want = x & ((1 << self.width) - 1)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self._low(mid) < want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

    def _run(self, x: np.ndarray) -> tuple[int, np.ndarray] | None:
        """(first position, values) of the run of values that the questions ``x`` lie in; None where it is long for so few."""
        if len(x) >= self.n:
            return 0, self.values()
        a, b = self._search(np.array([x.min(), x.max()])).tolist()
        b = min(b + 1, self.n)
        return (a, self.values(a, b)) if b - a <= RUN * len(x) else None

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value that is not below each ``x``; ``x`` must be in the universe.

        Questions that lie close are answered from one pass over the values between the least and the largest.
        """
        x = np.asarray(x, np.int64)
        if not len(x):
            return x
        run = self._run(x)
        return self._search(x) if run is None else run[0] + np.searchsorted(run[1], x)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each ``x``, -1 where it is not a value."""
        x = np.asarray(x, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), -1)
        run = self._run(x)
        if run is not None:
            a, values = run
            if not len(values):  # all are beyond the last value
                return np.full(len(x), -1)
            inside = np.minimum(np.searchsorted(values, x), len(values) - 1)
            return np.where(values[inside] == x, a + inside, -1)
        at = self._search(x)
        inside = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self._at(inside) == x), at, -1)

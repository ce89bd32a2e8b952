"""Monotone sequences in Elias-Fano form, kept in files and read through memory maps."""

from __future__ import annotations

import os

import numpy as np


def write(path: str, values: np.ndarray) -> None:
    """Write the non-decreasing unsigned `values`. Low parts are whole bytes wide; high parts are unary gaps in a bitset."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(n, 1)).bit_length())
    low_bytes = -(-width // 8)
    low = values.view(np.uint8).reshape(-1, 8)[:, :low_bytes] if n else np.zeros((0, low_bytes), np.uint8)
    high = (values >> np.uint64(8 * low_bytes)).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
    bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, dtype=np.uint8)
    bits[high + np.arange(n)] = 1
    with open(path, "wb") as f:
        np.array([n, low_bytes, len(bits)], dtype="<i8").tofile(f)
        np.ascontiguousarray(low.T).tofile(f)
        np.packbits(bits).tofile(f)


class Sequence:
    """A sequence that write() has left in `path`."""

    def __init__(self, path: str) -> None:
        self.n, self.low_bytes, n_bits = (int(x) for x in np.fromfile(path, dtype="<i8", count=3))
        data = np.memmap(path, dtype=np.uint8, mode="r", offset=24, shape=(os.path.getsize(path) - 24,)) if os.path.getsize(path) > 24 else np.zeros(0, np.uint8)
        self.low = data[: self.n * self.low_bytes].reshape(self.low_bytes, self.n)
        bits = np.unpackbits(data[self.n * self.low_bytes :], count=n_bits)
        ones = np.flatnonzero(bits)
        self.high = ones - np.arange(self.n)
        self.first = np.searchsorted(self.high, np.arange(n_bits - self.n + 1))  # of each high part; the last is n
        self.shift = np.uint64(8 * self.low_bytes)

    def low_at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), dtype=np.uint64)
        for b in range(self.low_bytes):
            out |= self.low[b][i].astype(np.uint64) << np.uint64(8 * b)
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        low = self.low_at(i)
        return low | (self.high[i].astype(np.uint64) << self.shift) if self.low_bytes < 8 else low

    def successor(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """For each value, the index of the first element not below it, from `start` and up to `stop` (both optional)."""
        values = values.astype(np.uint64)
        high = np.minimum((values >> self.shift).astype(np.int64), len(self.first) - 1) if self.low_bytes < 8 else np.zeros(len(values), np.int64)
        want = values & np.uint64((1 << (8 * self.low_bytes)) - 1)
        lo = self.first[high]
        hi = self.first[np.minimum(high + 1, len(self.first) - 1)]
        if start is not None:
            lo, hi = np.maximum(lo, start), np.maximum(hi, start)
        if stop is not None:
            lo, hi = np.minimum(lo, stop), np.minimum(hi, stop)
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.low_at(mid) < want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
        return lo

"""Counting quotient filters in numpy: exact counters of n-grams of 64-bit word ids.

A key of up to four ids is permuted: a mixing of its first id with a hash of
the others replaces the first, which can be undone. The first bits of the
result are the quotient, the rest of it and the other ids the remainder, kept
in full, so no two keys share a counter. A filter is sorted by permuted key.
Packed, quotients are one bitmap (one bit an entry behind as many zeros as the
quotient advances), remainders have the bytes that the quotient leaves, and
counters take one byte, or nine from 255 on. Sorted filters merge by a stable
sort, which joins their sorted runs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
R1, R2 = (pow(m, -1, 1 << 64) for m in (M1, M2))
HEAD = struct.Struct("<qQBB")
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(M1)
    x = (x ^ x >> U(27)) * U(M2)
    return x ^ x >> U(31)


def _unshifted(x: np.ndarray, n: int) -> np.ndarray:
    y = x
    for _ in range(64 // n):
        y = x ^ y >> U(n)
    return y


def _unmixed(x: np.ndarray) -> np.ndarray:
    x = _unshifted(x, 31) * U(R2)
    x = _unshifted(x, 27) * U(R1)
    return _unshifted(x, 30)


def _others(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), U)
    for k in range(1, keys.shape[1]):
        h = _mixed(h + keys[:, k] + U(k))
    return h


def permuted(keys: np.ndarray) -> np.ndarray:
    """Keys (rows of ids) with the first id replaced; undone by `restored`."""
    out = keys.copy()
    out[:, 0] = _mixed(keys[:, 0] + _others(keys))
    return out


def restored(keys: np.ndarray) -> np.ndarray:
    out = keys.copy()
    out[:, 0] = _unmixed(keys[:, 0]) - _others(keys)
    return out


class Filter:
    """Permuted keys in ascending order, each once, and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        """A filter of plain keys, which may repeat."""
        return cls._summed(permuted(np.ascontiguousarray(keys, U)), np.asarray(counts, np.int64))

    @classmethod
    def merged(cls, filters: Iterable[Filter]) -> Filter:
        filters = list(filters)
        if len(filters) == 1:
            return filters[0]
        return cls._summed(np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters]))

    @classmethod
    def _summed(cls, keys: np.ndarray, counts: np.ndarray) -> Filter:
        if not len(keys):
            return cls(keys, counts)
        order = np.argsort(keys[:, 0], kind="stable")
        for _ in range(2):
            rows = keys[order]
            other = (rows[1:] != rows[:-1]).any(axis=1)
            if not (other & (rows[1:, 0] == rows[:-1, 0])).any():
                break
            order = np.lexsort(keys.T[::-1])  # different keys with the same first word: sort by all
        starts = np.flatnonzero(np.concatenate([[True], other]))
        return cls(rows[starts], np.add.reduceat(counts[order], starts))

    def plain(self) -> np.ndarray:
        return restored(self.keys)

    def at_least(self, least: int) -> Filter:
        keep = self.counts >= least
        return Filter(self.keys[keep], self.counts[keep])

    def shards(self, n: int) -> list[tuple[int, Filter]]:
        """The parts of n equal ranges of permuted keys that are not empty."""
        place = ((self.keys[:, 0] >> U(32)) * U(n) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(place, np.arange(n + 1))
        return [(s, Filter(self.keys[a:b], self.counts[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]

    def packed(self) -> bytes:
        m, width = self.keys.shape
        first = self.keys[:, 0]
        span = int(first[-1] - first[0]) + 1 if m else 1
        bits = max(0, min(64, 64 - max(0, span.bit_length() - max(1, m.bit_length()))))
        low = 64 - bits  # bits of the remainder
        quotient = (first >> U(low)) if low < 64 else np.zeros(m, U)
        base = int(quotient[0]) if m else 0
        marks = np.zeros(int(quotient[-1]) - base + m + 1 if m else 0, np.uint8)
        marks[(quotient - U(base)).astype(np.int64) + np.arange(m)] = 1
        wide = -(-low // 8)
        rest = (first & U((1 << low) - 1)).astype("<u8").view(np.uint8).reshape(m, 8)[:, :wide] if m else np.zeros((0, wide), np.uint8)
        many = self.counts >= 255
        parts = [np.packbits(marks, bitorder="little"), rest, self.keys[:, 1:].astype("<u8"), np.where(many, 255, self.counts).astype(np.uint8), self.counts[many].astype("<i8")]
        return HEAD.pack(m, base, width, bits) + struct.pack("<q", len(parts[0])) + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def unpacked(cls, blob: bytes) -> Filter:
        m, base, width, bits = HEAD.unpack_from(blob)
        (n_marks,) = struct.unpack_from("<q", blob, HEAD.size)
        at, low = HEAD.size + 8, 64 - bits
        wide = -(-low // 8)

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        quotient = np.flatnonzero(np.unpackbits(take(n_marks, "u1"), bitorder="little"))[:m] - np.arange(m)
        rest = np.zeros((m, 8), np.uint8)
        rest[:, :wide] = take(m * wide, "u1").reshape(m, wide)
        keys = np.empty((m, width), U)
        keys[:, 0] = rest.view("<u8").ravel()
        if low < 64:
            keys[:, 0] |= quotient.astype(U) + U(base) << U(low)
        keys[:, 1:] = take(m * (width - 1), "<u8").reshape(m, width - 1)
        counts = take(m, "u1").astype(np.int64)
        many = counts == 255
        counts[many] = take(int(many.sum()), "<i8")
        return cls(keys, counts)

"""Counting quotient filters in numpy.

A filter holds 64-bit fingerprints of one shard, split into a quotient and a
remainder.  Per quotient, one bit says whether it is occupied and the length of
its run is kept; remainders lie sorted inside their run, and a counter follows
each of them.  With all 64 bits kept, a filter is lossless: two merge as sorted runs, the
smaller one's remainders are put in place among the larger one's, and counters
of equal ones are added; nothing is sorted again.
"""

from __future__ import annotations

import struct

import numpy as np

REMAINDER_BITS = 40


def _encode(fps: np.ndarray, total: np.ndarray) -> bytes:
    """A filter of ascending distinct fingerprints and their counters."""
    quotients = fps >> np.uint64(REMAINDER_BITS)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(fps)), bool), quotients[1:] != quotients[:-1])))
    runs = np.diff(np.append(first, len(fps)))
    low = fps & np.uint64((1 << REMAINDER_BITS) - 1)
    return b"".join(
        (
            struct.pack("<qq", len(fps), len(first)),
            quotients[first].astype("<u4").tobytes(),
            runs.astype("<u4").tobytes(),
            (low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(),
            (low >> np.uint64(32)).astype("u1").tobytes(),
            total.astype("<i8").tobytes(),
        )
    )


def build(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """A filter over ``fingerprints`` (uint64, any order, repeats add up)."""
    fps, inverse = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
    weights = np.ones(len(fingerprints), np.int64) if counts is None else counts.astype(np.int64)
    total = np.zeros(len(fps), np.int64)
    np.add.at(total, inverse, weights)
    return _encode(fps, total)


def size(filter_bytes: bytes) -> int:
    """How many fingerprints a filter holds."""
    return struct.unpack_from("<q", filter_bytes)[0]


def entries(filter_bytes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a filter and their counters."""
    n, q = struct.unpack_from("<qq", filter_bytes)
    at = 16
    parts = []
    for kind, count in (("<u4", q), ("<u4", q), ("<u4", n), ("u1", n), ("<i8", n)):
        parts.append(np.frombuffer(filter_bytes, kind, count, at))
        at += parts[-1].nbytes
    occupied, runs, low, high, total = parts
    quotient = np.repeat(occupied.astype(np.uint64), runs)
    remainder = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return (quotient << np.uint64(REMAINDER_BITS)) | remainder, total


def _merge_two(a: bytes, b: bytes) -> bytes:
    """Merge two sorted runs: each remainder of ``b`` finds its place in ``a``; equal ones add their counters."""
    (x, nx), (y, ny) = entries(a), entries(b)
    place = np.searchsorted(x, y)
    met = np.zeros(len(y), bool)
    inside = place < len(x)
    met[inside] = x[place[inside]] == y[inside]
    total = nx.copy()
    total[place[met]] += ny[met]
    return _encode(np.insert(x, place[~met], y[~met]), np.insert(total, place[~met], ny[~met]))


class Ladder:
    """Filters of falling size, the last less than half of the one before, so that n entries are merged about log n times."""

    def __init__(self) -> None:
        self.steps: list[bytes] = []

    def add(self, filter_bytes: bytes) -> None:
        self.steps.append(filter_bytes)
        while len(self.steps) > 1 and size(self.steps[-2]) < 2 * size(self.steps[-1]):
            last = self.steps.pop()
            self.steps[-1] = _merge_two(self.steps[-1], last)

    def whole(self) -> bytes:
        """One filter that counts what all filters count."""
        while len(self.steps) > 1:
            last = self.steps.pop()
            self.steps[-1] = _merge_two(self.steps[-1], last)
        return self.steps[0] if self.steps else build(np.zeros(0, np.uint64))


def merge(filters: list[bytes]) -> bytes:
    """One filter that counts what all of ``filters`` count."""
    ladder = Ladder()
    for f in sorted(filters, key=size, reverse=True):
        ladder.add(f)
    return ladder.whole()

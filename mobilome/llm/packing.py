"""Arrays and word lists as compressed binary values of one row."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import zstandard


def packed(a: np.ndarray, kind: str = "<i8") -> bytes:
    """Numbers by byte plane, which compresses far better than value by value."""
    a = np.ascontiguousarray(a, kind)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T) if a.size else a
    return zstandard.compress(planes.tobytes(), 1)


def unpacked(b: bytes, kind: str = "<i8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if raw.size else np.zeros(0, kind)


def packed_texts(texts: list[str]) -> bytes:
    """Texts of which none holds a line feed."""
    return zstandard.compress("\n".join(texts).encode(), 1)


def unpacked_texts(b: bytes, n: int) -> list[str]:
    return zstandard.decompress(b).decode().split("\n") if n else []


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks, beside others of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own counsel
        pass

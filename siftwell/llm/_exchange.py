"""Compact hash exchange between chunks of documents and hash buckets.

A chunk sends each bucket one row with its own distinct hashes, sorted.  The bucket answers with one bit for each, and the
chunk, which computes the same sorted list again, reads the bits back.  So a hash costs a few bytes on the wire, a very
frequent hash costs one entry per chunk at most, and no position or id travels back.
"""

from __future__ import annotations

import numpy as np


def bounds(sorted_keys: np.ndarray, bits: int, shift: int) -> np.ndarray:
    """Where each of the ``2 ** bits`` buckets begins in the sorted keys; the bucket is ``key >> shift``."""
    return np.searchsorted(sorted_keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(shift)) if shift + bits < 64 else np.append(
        np.searchsorted(sorted_keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift)), len(sorted_keys)
    )


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences, of three bytes each where all fit, else of four."""
    d = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    width = 3 if not len(d) or int(d.max()) < 1 << 24 else 4
    return bytes([width]) + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4)[:, :width]).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    d = np.zeros((len(raw), 4), np.uint8)
    d[:, :width] = raw
    return np.cumsum(d.view("<u4")[:, 0], dtype=np.uint32)


def planes(x: np.ndarray) -> bytes:
    """The numbers' bytes, all first bytes, then all second bytes, ...: planes of zeros compress to nothing."""
    x = np.ascontiguousarray(x)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(blob: bytes, dtype: str, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(dtype)[:, 0] if n else np.zeros(0, dtype)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(blob: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(bool)


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)

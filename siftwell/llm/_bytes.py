"""Vectorised hashing of words, word windows and byte windows over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
PAD = 16


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(32)
    h *= _K2
    h ^= h >> np.uint64(29)
    h *= _K3
    h ^= h >> np.uint64(32)
    return h


def concat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes, one newline after each, and the offsets: text i is ``buf[off[i] : off[i + 1] - 1]``."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.string())
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if n == 0:
        return np.full(PAD, 10, np.uint8), np.zeros(1, np.int64)
    src = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[src[0] : src[-1]] if data is not None else np.zeros(0, np.uint8)
    src = src - src[0]
    off = src + np.arange(n + 1)
    buf = np.full(off[-1] + PAD, 10, np.uint8)
    keep = np.ones(off[-1], bool)
    keep[off[1:] - 1] = False
    buf[: off[-1]][keep] = data
    return buf, off


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text.  Words match ``[^\\x20\\x09-\\x0D]+``."""
    end = int(off[-1])
    gap = np.empty(end + 1, bool)
    gap[0] = True
    np.take(_IS_SEPARATOR, buf[:end], out=gap[1:])
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    first = np.searchsorted(starts, off)
    return starts, ends, np.diff(first)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as numbers; ``buf`` has at least ``PAD`` bytes after the last text."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


def span_hash(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans; the cost follows the number of spans and their lengths, eight bytes a step."""
    view = lanes(buf)
    h = lens.astype(np.uint64) * _K1 + np.uint64(seed)
    todo, at, left = np.arange(len(starts)), starts.astype(np.int64), lens.astype(np.int64)
    while len(todo):
        part = view[at] & _LOW[np.minimum(left, 8)]
        if len(todo) == len(h):
            h ^= part
            h *= _K1
            mix(h)
        else:
            got = (h[todo] ^ part) * _K1
            h[todo] = mix(got)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


def _join(a: np.ndarray, b: np.ndarray, k: np.uint64) -> np.ndarray:
    h = a * k
    h ^= h >> np.uint64(31)
    h += b
    h *= _K2
    h ^= h >> np.uint64(30)
    return h


def window_hash(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive items, by joining runs of doubled length."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = np.uint64((int(_K1) + 2 * seed) & ((1 << 64) - 1))
    cur, size, acc, held = h, 1, None, 0
    while True:
        if n & size:
            if acc is None:
                acc, held = cur, size
            else:
                m = len(h) - size - held + 1
                acc, held = _join(cur[:m], acc[size : size + m], k), size + held
        if 2 * size > n:
            break
        cur = _join(cur[: len(h) - 2 * size + 1], cur[size : len(h) - size + 1], k)
        size *= 2
    return mix(acc.copy() if acc is h else acc)


def repeat_index(counts: np.ndarray) -> np.ndarray:
    """0 for the items of the first text, 1 for those of the second, ..."""
    return np.repeat(np.arange(len(counts)), counts)


def window_offsets(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c in turn."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct numbers, by sorting: for hashes much faster than a table of them."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]

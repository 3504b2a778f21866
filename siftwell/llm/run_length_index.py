"""A run-length compressed BWT with sampled run ends, and matching statistics streamed over it.

The index of a repetitive collection keeps one entry per run of equal letters in its Burrows-Wheeler transform: the letter,
the run's length, and the text positions of the run's first and last suffix.  Repeats within the collection need nothing
else: the longest common prefix of a suffix with its lexicographic neighbour falls by exactly one per text position, except
at positions sampled at a run's border.  So common prefixes are computed at the borders only, as many as there are runs, and
the statistics of all other positions follow by streaming over the text.

Order: suffixes compare up to their document's end; equal ones order by position, which keeps that rule exact.
"""

from __future__ import annotations

import numpy as np

from ._bytes import _LOW, lanes

#: Ends a document.  No UTF-8 text holds this byte.
SEPARATOR = 0xFF


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions by suffix, where ``left`` letters count from each position on.

    Prefix doubling from eight-byte keys; only suffixes that are still tied are sorted again.
    """
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    key = (lanes(padded)[:n] & _LOW[np.minimum(left + 1, 8)]).byteswap()
    sa = np.argsort(key, kind="stable")
    ranked = key[sa]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    head = np.flatnonzero(new)
    rank[sa] = np.repeat(head, np.diff(np.append(head, n)))
    have, most = 8, int(left.max(initial=0)) + 1
    while have < most:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        at = at[left[sa[at]] >= have]  # shorter ones are equal to their end
        if not len(at):
            break
        suffix = sa[at]
        first, second = rank[suffix], rank[suffix + have]
        order = np.argsort((first << 32) | second, kind="stable")
        suffix, first, second = suffix[order], first[order], second[order]
        sa[at] = suffix
        fresh = np.ones(len(at), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[at] = fresh
        head = np.flatnonzero(fresh)
        rank[suffix] = np.repeat(at[head], np.diff(np.append(head, len(at))))
        have *= 2
    return sa


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes ``a`` and ``b``, up to ``most`` each, eight letters a step."""
    padded = np.zeros(len(text) + 24, np.uint8)
    padded[: len(text)] = text
    view = lanes(padded)
    out = np.zeros(len(a), np.int64)
    todo, step = np.flatnonzero(most > 0), 0
    while len(todo):
        differ = view[a[todo] + step] ^ view[b[todo] + step]
        end = differ != 0
        low = differ[end] & (~differ[end] + np.uint64(1))
        out[todo[end]] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        todo, step = todo[~end], step + 8
        out[todo] = step
        todo = todo[most[todo] > step]
    return np.minimum(out, most)


class RunLengthIndex:
    """``letters, lengths``: the runs of the transform; ``first, last``: text positions of each run's end suffixes.

    ``text``: documents of bytes, each followed by ``SEPARATOR``.  At most 2 ** 31 letters.
    """

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        stop = np.flatnonzero(text == SEPARATOR)
        self.left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) if n else np.zeros(0, np.int64)
        sa = suffix_array(text, self.left)
        before = np.where(sa > 0, text[sa - 1], SEPARATOR)
        border = np.ones(n, bool)
        border[1:] = (before[1:] != before[:-1]) | (before[1:] == SEPARATOR)
        start = np.flatnonzero(border)
        self.letters, self.lengths = before[start], np.diff(np.append(start, n))
        self.first, self.last = sa[start], sa[start + self.lengths - 1]

    def transform(self) -> np.ndarray:
        """The Burrows-Wheeler transform, from its runs."""
        return np.repeat(self.letters, self.lengths)

    def _stream(self, at: np.ndarray, other: np.ndarray, copies: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        n = len(self.text)
        out, sampled = np.zeros(n, np.int64), np.zeros(n, np.int64)
        out[at] = common_prefix(self.text, at, other, np.minimum(self.left[at], self.left[other]))
        sampled[at] = at
        np.maximum.accumulate(sampled, out=sampled)
        here = np.maximum(out[sampled] - (np.arange(n) - sampled), 0)
        if copies is not None:
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, copies[0], copies[0] + copies[1])
            here = np.maximum(here, np.maximum.accumulate(reach) - np.arange(n))
        return here

    def matching_statistics(self, copies: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """For each position, the length of the longest string from there on that also starts elsewhere.

        ``copies``: positions and lengths of strings that have copies outside the index.
        """
        if not len(self.text):
            return np.zeros(0, np.int64)
        # A run's first suffix follows the last one of the run before it, and the other way round.
        up = self._stream(self.first[1:], self.last[:-1], copies)
        return np.minimum(np.maximum(up, self._stream(self.last[:-1], self.first[1:])), self.left)

"""Exact substring dedup with fixed-block anchors.

Method.  The non-overlapping blocks of ``window // 2`` words (rounded up) of every document are the reference index: of each
block's hash it holds the smallest document that has it, and where.  Every rolling run of as many words of every document
probes it.  A repeat of ``window`` words holds at least one whole block of either copy, so nothing outside the surroundings of
hits can repeat.  Hits that follow one another in both documents form chains, and all that a chain covers repeats; a chain's
two ends, and hits that are in no chain, are extended word by word: each window around them is matched by a 96-bit hash against
the smallest document that has it.  The union of chains and matched windows is the maximal repeats.

Plan.  Documents are dealt into chunks once (one exchange, reused by three steps):

1. each chunk sends its distinct block-length hashes (about 3 bytes each, 12 more words' worth for those that are blocks) to hash
   buckets, which answer one bit per hash (some document has it as a block, and it occurs in more than one place) and the
   block's place for each hit;
2. each chunk chains its hits, and sends the windows that no chain settles with the smallest document that has them; buckets
   answer one bit: some other chunk has it in a smaller document;
3. each chunk marks, cuts and returns its documents.

A window that a third of all documents share costs one entry per chunk at most.  Nothing is collected or broadcast.

Defined cases: null text has no words; null id orders after every other id and never removes or loses words against
another null id; repeated rows with one id count as one document, so ties of the smallest id remove nothing from each other;
documents under ``window`` words lose nothing, texts of any length are read whole; an empty table gives an empty result; other
columns play no part and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _exchange as X
from ._common import LAST_ID, bucket_bits, chunks_for, id_and_text, text_bytes, with_chunk

RESULT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>"


class _Chunk:
    """The words of one chunk of documents, ordered by id so that every attempt sees the same.

    ``ids`` of null ids are ``LAST_ID``, and ``none`` tells them apart from a document of that id.
    """

    def __init__(self, table: pa.Table):
        self.raw = table.column("doc_id")
        self.none = pc.is_null(self.raw).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        self.ids = pc.fill_null(self.raw, LAST_ID).to_numpy()
        self.buf, self.off = B.concat(table.column("text"))
        self.starts, self.ends, self.counts = B.words(self.buf, self.off)
        self.doc = B.repeat_index(self.counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hash = B.span_hash(self.buf, self.starts, self.ends - self.starts)
        self.left = self.first[1:][self.doc] - np.arange(len(self.starts))  # words from here to the document's end

    def blocks(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose ``n`` words lie in one document, and their hashes cut to ``bits + 32`` bits."""
        at = np.flatnonzero(self.left >= n)
        return at, B.window_hash(self.hash, n)[at] >> np.uint64(32 - bits)

    def windows(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return B.window_hash(self.hash, n, 1)[at], (B.window_hash(self.hash, n, 2)[at] >> np.uint64(32)).astype(np.uint32)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Names of positions: 32 bits of the whole text, which part rows with one id, and the word's number."""
        at_word = np.arange(len(self.hash)) - self.first[self.doc]
        total = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(self.hash + at_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))])
        text = total[self.first[1:]] - total[self.first[:-1]]
        return ((text[self.doc[at]] & np.uint64(0xFFFFFFFF00000000)) | at_word[at].astype(np.uint64)).view(np.int64)


def _table(schema: pa.Schema, **columns: list) -> pa.Table:
    return pa.table([x if isinstance(x := columns[f.name], pa.ChunkedArray) else pa.array(x, f.type) for f in schema], schema=schema)


_MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
_MESSAGE_SQL = "bucket int, chunk int, n int, blob binary"


def _least_of(group: np.ndarray, none: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups, and where in the input each has its smallest entry: by id, null last, then by place."""
    order = np.lexsort((place, ids, none, group))
    start = X.group_starts(group[order])
    return group[order[start]], order[start]


def _send_blocks(n: int, bits: int):
    def send(key, table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        at, h = c.blocks(n, bits)
        own, times = np.unique(h, return_counts=True)
        block = at[(at - c.first[c.doc[at]]) % n == 0]
        of = np.searchsorted(own, h[np.searchsorted(at, block)])
        place = c.places(block)
        mine, best = _least_of(of, c.none[c.doc[block]], c.ids[c.doc[block]], place)
        aligned = np.zeros(len(own), bool)
        aligned[mine] = True
        ids, none, place = c.ids[c.doc[block[best]]], c.none[c.doc[block[best]]], place[best]
        edge, out = X.bounds(own, bits, 32), ([], [], [], [])
        at_block = np.searchsorted(mine, edge)
        fp = (own & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for b in np.flatnonzero(np.diff(edge)):
            i, j, k, m = edge[b], edge[b + 1], at_block[b], at_block[b + 1]
            blob = X.bits_of(aligned[i:j]) + X.bits_of(times[i:j] > 1) + X.bits_of(none[k:m]) + X.planes(ids[k:m]) + X.planes(place[k:m]) + X.pack_sorted(fp[i:j])
            for x, y in zip(out, (b, key[0].as_py(), j - i, blob), strict=True):
                x.append(y)
        return _table(_MESSAGE, bucket=out[0], chunk=out[1], n=out[2], blob=out[3])

    return send


def _answer_blocks(key, table):
    """One bit per hash that was sent: a block somewhere, and more than one occurrence; for each hit the smallest block's place."""
    n = table.column("n").to_numpy()
    blobs = table.column("blob").to_pylist()
    size = (n + 7) // 8
    flags, many, fps, none, ids, place = [], [], [], [], [], []
    for x, k, s in zip(blobs, n.tolist(), size.tolist(), strict=True):
        flags.append(X.flags_of(x, k))
        many.append(X.flags_of(x, k, s))
        m = int(flags[-1].sum())
        at = 2 * s + (m + 7) // 8
        none.append(X.flags_of(x, m, 2 * s))
        ids.append(X.unplanes(x, "<i8", m, at))
        place.append(X.unplanes(x, "<i8", m, at + 8 * m))
        fps.append(X.unpack_sorted(x[at + 16 * m :]))
    fp, aligned, many, none, ids, place = (np.concatenate(x) for x in (fps, flags, many, none, ids, place))
    order = np.argsort(fp, kind="stable")
    start = X.group_starts(fp[order])
    count = np.diff(np.append(start, len(fp)))
    hit = np.logical_or.reduceat(aligned[order], start) & ((count > 1) | np.logical_or.reduceat(many[order], start))
    group = np.empty(len(fp), np.int64)
    group[order] = np.repeat(np.arange(len(start)), count)
    bit = hit[group]
    mine, best = _least_of(group[aligned], none, ids, place)
    at = np.zeros(len(start), np.int64)
    at[mine] = best
    edge, out = np.concatenate([[0], np.cumsum(n)]), ([], [], [], [])
    for i, (bucket, chunk) in enumerate(zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), strict=True)):
        flag = bit[edge[i] : edge[i + 1]]
        if flag.any():
            ref = at[group[edge[i] : edge[i + 1]][flag]]
            blob = X.bits_of(flag) + X.bits_of(none[ref]) + X.planes(ids[ref]) + X.planes(place[ref])
            for x, y in zip(out, (bucket, chunk, int(n[i]), blob), strict=True):
                x.append(y)
    return _table(_MESSAGE, bucket=out[0], chunk=out[1], n=out[2], blob=out[3])


def _read_bits(own_edge: np.ndarray, total: int, answers: pa.Table) -> np.ndarray:
    hit = np.zeros(total, bool)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
        i, j = own_edge[b], own_edge[b + 1]
        hit[i:j] = X.flags_of(blob, j - i)
    return hit


def _read_hits(own_edge: np.ndarray, total: int, answers: pa.Table) -> tuple[np.ndarray, ...]:
    """Which hashes hit, and of each the smallest block: whether its id is null, its id, its place."""
    hit, none = np.zeros((2, total), bool)
    ids, place = np.zeros((2, total), np.int64)
    for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True):
        i, j = own_edge[b], own_edge[b + 1]
        flag = X.flags_of(blob, j - i)
        at, m, size = i + np.flatnonzero(flag), int(flag.sum()), (j - i + 7) // 8
        hit[at], none[at] = True, X.flags_of(blob, m, size)
        size += (m + 7) // 8
        ids[at], place[at] = X.unplanes(blob, "<i8", m, size), X.unplanes(blob, "<i8", m, size + 8 * m)
    return hit, none, ids, place


def _candidates(c: _Chunk, hits: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts of the windows that hold a hit block."""
    run = np.concatenate([[0], np.cumsum(hits)])
    n = len(hits)
    at = np.flatnonzero(c.left >= window)
    return at[run[np.minimum(at + window - block + 1, n)] > run[at]]


def _chained(c: _Chunk, at: np.ndarray, none: np.ndarray, ids: np.ndarray, place: np.ndarray, window: int, block: int) -> np.ndarray:
    """Which windows lie wholly in a chain: hits at ``at``, ``block`` words apart, on blocks that follow one another in a smaller document."""
    n = len(c.starts)
    lost = np.zeros(n + 1, np.int32)
    doc = c.doc[at]
    smaller = ~none & (c.none[doc] | (ids < c.ids[doc]))
    at, ids, place = at[smaller], ids[smaller], place[smaller]
    of = np.full(n + block, -1)
    of[at] = np.arange(len(at))
    after = of[at + block]
    ok = after >= 0
    ok &= (c.left[at] >= 2 * block) & (ids[after] == ids) & (place[after] == place + block)
    # Runs of linked hits, each residue of the position on its own.
    rows = -(-n // block) + 1
    grid = np.zeros(rows * block, bool)
    grid[at[ok]] = True
    start, stop = runs(np.ascontiguousarray(grid.reshape(rows, block).T).ravel())
    first = (start % rows) * block + start // rows
    np.add.at(lost, first, 1)
    np.add.at(lost, first + (stop - start + 1) * block - window + 1, -1)
    return np.cumsum(lost[:-1]) > 0


def _distinct_windows(c: _Chunk, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Order, group starts and the sorted hashes of the windows at ``at``, with the smallest document of each group and whether
    all its documents have null ids."""
    a, b = c.windows(at, window)
    order = np.lexsort((b, a))
    a, b, doc = a[order], b[order], c.doc[at[order]]
    start = X.group_starts(a, b)
    least = np.minimum.reduceat(c.ids[doc], start) if len(start) else np.zeros(0, np.int64)
    none = np.logical_and.reduceat(c.none[doc], start) if len(start) else np.zeros(0, bool)
    return order, start, a[start], b[start], least, none


def _send_windows(window: int, block: int, bits: int):
    def send(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _MESSAGE.empty_table()
        c = _Chunk(docs)
        at, h = c.blocks(block, bits)
        order = np.argsort(h)
        start = X.group_starts(h[order])
        own, of = h[order[start]], np.empty(len(h), np.int64)
        of[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(h))))
        hit, *ref = _read_hits(X.bounds(own, bits, 32), len(own), answers)
        at, of = at[hit[of]], of[hit[of]]
        chained = _chained(c, at, *(x[of] for x in ref), window, block)
        hits = np.zeros(len(c.starts), bool)
        hits[at] = True
        cand = _candidates(c, hits, window, block)
        cand = cand[~chained[cand]]
        _, _, a, b, least, none = _distinct_windows(c, cand, window)
        edge, chunk = X.bounds(a, bits, 64 - bits), key[0].as_py()
        flags = np.zeros(len(c.starts), bool)
        flags[cand] = True
        out = ([-1 - chunk], [chunk], [len(c.starts)], [X.bits_of(flags) + X.bits_of(chained)])
        for k in np.flatnonzero(np.diff(edge)):
            i, j = edge[k], edge[k + 1]
            for x, y in zip(out, (k, chunk, j - i, a[i:j].tobytes() + b[i:j].tobytes() + X.planes(least[i:j]) + X.bits_of(none[i:j])), strict=True):
                x.append(y)
        return _table(_MESSAGE, bucket=out[0], chunk=out[1], n=out[2], blob=out[3])

    return send


def _answer_windows(key, table):
    """One bit per window that was sent: another chunk has it in a smaller document.  Rows of negative buckets pass."""
    if key[0].as_py() < 0:
        return table.select(_MESSAGE.names).cast(_MESSAGE)
    n = table.column("n").to_numpy()
    blobs = table.column("blob").to_pylist()
    a = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(blobs, n, strict=True)])
    b = np.concatenate([np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(blobs, n, strict=True)])
    least = np.concatenate([X.unplanes(x, "<i8", k, 12 * k) for x, k in zip(blobs, n, strict=True)])
    none = np.concatenate([X.flags_of(x, k, 20 * k) for x, k in zip(blobs, n, strict=True)])
    order = np.lexsort((b, a))
    start = X.group_starts(a[order], b[order])
    count = np.diff(np.append(start, len(a)))
    known = ~np.logical_and.reduceat(none[order], start)
    beaten = np.empty(len(a), bool)
    beaten[order] = np.repeat(known, count) & (none[order] | (least[order] > np.repeat(np.minimum.reduceat(least[order], start), count)))
    edge = np.concatenate([[0], np.cumsum(n)])
    keep = [i for i in range(len(n)) if beaten[edge[i] : edge[i + 1]].any()]
    chunk, bucket = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    return _table(_MESSAGE, bucket=[bucket[i] for i in keep], chunk=[chunk[i] for i in keep], n=[int(n[i]) for i in keep], blob=[X.bits_of(beaten[edge[i] : edge[i + 1]]) for i in keep])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    d = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _cut(window: int, bits: int):
    def cut(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        c = _Chunk(docs)
        gone = np.zeros(len(c.starts), bool)
        bucket = answers.column("bucket").to_numpy() if answers.num_rows else np.zeros(0, np.int32)
        own = [x for x, k in zip(answers.column("blob").to_pylist(), bucket, strict=True) if k < 0]
        if own:
            cand = np.flatnonzero(X.flags_of(own[0], len(c.starts)))
            order, start, a, _, least, none = _distinct_windows(c, cand, window)
            beaten = _read_bits(X.bounds(a, bits, 64 - bits), len(a), answers.filter(pa.array(bucket >= 0)))
            count = np.diff(np.append(start, len(cand)))
            doc = c.doc[cand[order]]
            lost = cand[order][np.repeat(beaten, count) | (~np.repeat(none, count) & (c.none[doc] | (c.ids[doc] > np.repeat(least, count))))]
            lost = np.concatenate([lost, np.flatnonzero(X.flags_of(own[0], len(c.starts), (len(c.starts) + 7) // 8))])
            step = np.zeros(len(c.starts) + 1, np.int64)
            np.add.at(step, lost, 1)
            np.add.at(step, np.minimum(lost + window, len(c.starts)), -1)
            gone = np.cumsum(step)[:-1] > 0
        # The kept words, each followed by the one byte after it, which becomes a space.
        step = np.zeros(len(c.buf) + 1, np.int8)
        keep = ~gone
        step[c.starts[keep]] += 1
        step[np.minimum(c.ends[keep] + 1, len(c.buf))] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        clean = c.buf.copy()
        clean[c.ends[keep]] = 32
        clean = clean[inside].tobytes()
        size = np.add.reduceat(np.append(np.where(keep, c.ends - c.starts + 1, 0), 0), np.minimum(c.first[:-1], len(keep))) * (c.counts > 0)
        edge = np.concatenate([[0], np.cumsum(size)])
        texts = [clean[edge[i] : max(edge[i], edge[i + 1] - 1)] for i in range(len(c.ids))]
        removed = np.bincount(c.doc[gone], minlength=len(c.ids))
        spans = [[] for _ in range(len(c.ids))]
        for i in np.flatnonzero(removed):
            spans[i] = [{"start": int(x), "end": int(y)} for x, y in zip(*runs(gone[c.first[i] : c.first[i + 1]]), strict=True)]
        return _table(_RESULT, doc_id=c.raw, n_words=c.counts, n_removed=removed, kept_text=pa.array(texts, pa.binary()).cast(pa.string()), spans=spans)

    return cut


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """Removes every word covered by a ``window``-word run that also starts in a document with a smaller id.

    Returns ``doc_id, n_words, n_removed, kept_text, spans``; spans are word positions, ends exclusive.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    pairs = id_and_text(docs, id_col, text_col)
    total = text_bytes(pairs)
    bits = bucket_bits(total)
    dealt = with_chunk(pairs, chunks_for(total))
    # A chunk's rows in one order on every attempt, with repeated ids together.
    by_chunk = dealt.groupBy("chunk")
    blocks = by_chunk.applyInArrow(_ordered(_send_blocks(block, bits)), _MESSAGE_SQL)
    hits = blocks.groupBy("bucket").applyInArrow(_answer_blocks, _MESSAGE_SQL)
    sent = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_ordered2(_send_windows(window, block, bits)), _MESSAGE_SQL)
    beaten = sent.groupBy("bucket").applyInArrow(_answer_windows, _MESSAGE_SQL)
    return by_chunk.cogroup(beaten.groupBy("chunk")).applyInArrow(_ordered2(_cut(window, bits)), RESULT)


_ORDER = [("doc_id", "ascending"), ("text", "ascending")]


def _ordered(f):
    return lambda key, table: f(key, table.sort_by(_ORDER))


def _ordered2(f):
    return lambda key, docs, answers: f(key, docs.sort_by(_ORDER), answers)

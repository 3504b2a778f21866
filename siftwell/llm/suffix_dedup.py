"""Exact removal of long repeated byte strings with a run-length compressed BWT.

A string of ``length`` bytes is repeated if it starts at two places, in one document or in two.  All bytes that a repeated
string covers are removed.

No index over 100 TB can sit on one machine, so strings are first brought together by their content:

1. Anchors.  Of all ``ANCHOR``-byte strings within a string of ``length`` bytes, the one with the smallest hash is its anchor;
   both copies of a repeat choose the same.  An anchor's context is all strings that hold it: up to ``length - ANCHOR`` bytes
   on either side.  Chunks send anchors and hashes of their contexts to buckets.  An anchor that is there once can't be in a
   repeat; all others are asked for, of equal contexts one text.
2. Chunks send these texts to buckets by anchor, and their claims to equal ones.  A bucket builds the run-length index of its
   texts (merged where they overlap in a document, so that each position is there once), streams the matching statistics, in
   which copies of a text count as samples, and answers every claim with the statistics of ``length`` and more.
   An anchor with over ``MOST_CONTEXTS`` different contexts would overfill one index, and no other anchor parts them: each
   differs in the bytes beside a passage that, say, a third of all documents share.  Its strings are anchors of full length,
   told apart by 128-bit hashes, which are dealt by hash and are distinct per chunk: the exact way for the rest.
3. Chunks mark and cut their documents.

Documents are dealt into chunks by one exchange that all three steps reuse.  What a step found out about its own chunk
travels to the next step as one row.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing, texts of any length are read whole; equal
rows are different places, so both lose everything, and there are no ties to decide; null ids stay null; an empty table gives
an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import _exchange as X
from ._common import bucket_bits, chunks_for, id_and_text, text_bytes, with_carry, with_chunk
from .run_length_index import SEPARATOR, RunLengthIndex
from .substring_dedup import runs

ANCHOR = 64
MOST_CONTEXTS = 1000
#: Bytes of text in one index, but for one anchor's contexts, which stay together.
INDEX_BYTES = 1 << 20
SLAB = 1 << 20

_TABLE = np.random.default_rng(97).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
MESSAGE_SQL = "bucket int, chunk int, at int, n int, blob binary"


class _Out:
    def __init__(self):
        self.rows = ([], [], [], [], [])

    def add(self, *row):
        for x, y in zip(self.rows, row, strict=True):
            x.append(y)

    def table(self) -> pa.Table:
        return pa.table([pa.array(x, f.type) for x, f in zip(self.rows, MESSAGE, strict=True)], schema=MESSAGE)


def anchors(buf: np.ndarray, off: np.ndarray, length: int, k: int) -> np.ndarray:
    """Positions of the smallest-hash ``k``-byte string of every ``length``-byte string of every text."""
    w, found, i, n = length - k + 1, [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLAB, "right")) - 1)
        a, b = int(off[i]), int(off[j])
        if b - a > length:
            key = B.window_hash(_TABLE[buf[a:b]], k)
            key = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
            m = len(key) - w + 1
            if m > 0:
                rows = -(-len(key) // w)
                grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
                grid[: len(key)] = key
                grid = grid.reshape(rows, w)
                ahead = np.minimum.accumulate(grid, axis=1).ravel()
                back = np.ascontiguousarray(np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).ravel()
                least = np.minimum(back[:m], ahead[w - 1 : w - 1 + m])
                whole = np.zeros(m + 1, np.int32)  # starts of strings that lie in one text
                lens = off[i + 1 : j + 1] - 1 - off[i:j]
                long = np.flatnonzero(lens >= length)
                np.add.at(whole, off[i:j][long] - a, 1)
                np.add.at(whole, np.minimum(off[i:j][long] - a + lens[long] - length + 1, m), -1)
                least = least[np.cumsum(whole[:-1]) > 0]
                if len(least):
                    keep = np.ones(len(least), bool)
                    keep[1:] = least[1:] != least[:-1]
                    found.append(B.distinct((least[keep] & np.uint64(0xFFFFFFFF)).astype(np.int64)) + a)
        i = j
    return np.concatenate(found) if found else np.zeros(0, np.int64)


class _Chunk:
    def __init__(self, table: pa.Table, length: int):
        self.length = length
        self.ids = table.column("doc_id")
        self.buf, self.off = B.concat(table.column("text"))

    def contexts(self, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        doc = np.searchsorted(self.off, p, "right") - 1
        return np.maximum(self.off[doc], p + k - self.length), np.minimum(self.off[doc + 1] - 1, p + self.length)


def _send_anchors(length: int, k: int, bits: int):
    def send(key, table):
        chunk, out = key[0].as_py(), _Out()
        c = _Chunk(table.sort_by(_ORDER), length)
        p = anchors(c.buf, c.off, length, k)
        if not len(p):
            return out.table()
        s, e = c.contexts(p, k)
        fp = B.span_hash(c.buf, p, np.full(len(p), k), 11)
        lead = (p - s).astype(np.uint64) << np.uint64(40)
        a = B.mix(B.span_hash(c.buf, s, e - s, 12) ^ lead)
        b = (B.mix(B.span_hash(c.buf, s, e - s, 0xABCDEF) + lead * np.uint64(7)) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a, fp))
        start = X.group_starts(fp[order], a[order], b[order])
        count = np.diff(np.append(start, len(p)))
        entry = np.empty(len(p), np.int32)
        entry[order] = np.repeat(np.arange(len(start)), count)
        own = order[start]
        fp, a, b, many = fp[own], a[own], b[own], count > 1
        edge = X.bounds(fp, bits, 64 - bits)
        for g in np.flatnonzero(np.diff(edge)):
            i, j = edge[g], edge[g + 1]
            out.add(g, chunk, i, j - i, fp[i:j].tobytes() + a[i:j].tobytes() + b[i:j].tobytes() + X.bits_of(many[i:j]))
        out.add(-1 - chunk, chunk, len(own), len(p), p.tobytes() + entry.tobytes())
        return out.table()

    return send


def _answer_anchors(most: int):
    """Three bits for each context: a claim to it is asked for; its text is; its strings' hashes are."""

    def answer(key, table):
        if key[0].as_py() < 0:
            return table.select(MESSAGE.names).cast(MESSAGE)
        n, blobs = table.column("n").to_numpy(), table.column("blob").to_pylist()
        part = lambda t, size, at: np.concatenate([np.frombuffer(x, t, m, at * m) for x, m in zip(blobs, n, strict=True)])
        fp, a, b = part(np.uint64, 8, 0), part(np.uint64, 8, 8), part(np.uint32, 4, 16)
        many = np.concatenate([X.flags_of(x, m, 20 * m) for x, m in zip(blobs, n, strict=True)])
        order = np.lexsort((np.repeat(table.column("chunk").to_numpy(), n), b, a, fp))
        start = X.group_starts(fp[order], a[order], b[order])
        count = np.diff(np.append(start, len(fp)))
        several = (count > 1) | many[order[start]]
        group = X.group_starts(fp[order[start]])
        size = np.diff(np.append(group, len(start)))
        again = (size > 1) | np.logical_or.reduceat(several, group)  # the anchor is there more than once
        hot = np.repeat(again & (size > most), size)
        ask = np.repeat(again & (size <= most), size)
        bit = np.zeros((3, len(fp)), bool)
        bit[0][order] = np.repeat(ask, count)
        bit[1][order[start[ask]]] = True  # the first chunk that has it
        bit[2][order] = np.repeat(hot, count)
        edge, out = np.concatenate([[0], np.cumsum(n)]), _Out()
        for i, (g, chunk, at) in enumerate(zip(table.column("bucket").to_pylist(), table.column("chunk").to_pylist(), table.column("at").to_pylist(), strict=True)):
            mine = bit[:, edge[i] : edge[i + 1]]
            if mine.any():
                out.add(g, chunk, at, int(n[i]), b"".join(X.bits_of(x) for x in mine))
        return out.table()

    return answer


def _hot_starts(c: _Chunk, p: np.ndarray, k: int) -> np.ndarray:
    """Starts of all strings that hold one of the anchors ``p``, each once."""
    s, e = c.contexts(p, k)
    n = np.maximum(e - s - c.length + 1, 0)
    return B.distinct(np.repeat(s, n) + B.window_offsets(n))


def _string_hashes(c: _Chunk, at: np.ndarray):
    out = np.empty((2, len(at)), np.uint64)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        for j in range(2):
            out[j, i : i + (1 << 16)] = B.span_hash(c.buf, part, np.full(len(part), c.length), 21 + j * 0x5555)
    order = np.lexsort((out[1], out[0]))
    a, b = out[0][order], out[1][order]
    return order, X.group_starts(a, b), a, b


def _send_texts(length: int, k: int, bits: int):
    def send(key, docs, answers):
        chunk, out = key[0].as_py(), _Out()
        if not docs.num_rows or not answers.num_rows:
            return out.table()
        rows = list(zip(*(answers.column(x).to_pylist() for x in ("bucket", "at", "n", "blob")), strict=True))
        own = next((r for r in rows if r[0] < 0), None)
        if own is None or len(rows) == 1:
            return out.table()
        c = _Chunk(docs.sort_by(_ORDER), length)
        _, entries, n, blob = own
        p, entry = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int32, n, 8 * n)
        bit = np.zeros((3, entries), bool)
        for g, at, m, x in rows:
            if g >= 0:
                for j in range(3):
                    bit[j, at : at + m] = X.flags_of(x, m, j * ((m + 7) // 8))
        ask, ship, hot = bit
        times = np.bincount(entry, minlength=entries)
        one = np.zeros(entries, np.int64)
        one[entry[::-1]] = np.arange(n)[::-1]
        want = np.flatnonzero(ask)
        if len(want):
            q = p[one[want]]
            fp = B.span_hash(c.buf, q, np.full(len(q), k), 11)
            s, e = c.contexts(q, k)
            name = B.mix(B.span_hash(c.buf, s, e - s, 12) ^ ((q - s).astype(np.uint64) << np.uint64(40)))
            flags = ship[want].astype(np.uint8) | ((times[want] > 1).astype(np.uint8) << 1)
            bucket = fp >> np.uint64(64 - bits)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=np.uint64))
            for g in np.flatnonzero(np.diff(edge)):
                i = order[edge[g] : edge[g + 1]]
                t = i[ship[want[i]]]
                texts = [c.buf[x:y].tobytes() for x, y in zip(s[t], e[t], strict=True)]
                out.add(g, chunk, len(t), len(i), want[i].astype(np.int32).tobytes() + fp[i].tobytes() + name[i].tobytes() + s[t].tobytes() + e[t].tobytes() + flags[i].tobytes() + b"".join(texts))
        if hot.any():
            at = _hot_starts(c, p[hot[entry]], k)
            order, start, a, b = _string_hashes(c, at)
            many = np.diff(np.append(start, len(at))) > 1
            a, b = a[start], b[start]
            edge = X.bounds(a, bits, 64 - bits)
            for g in np.flatnonzero(np.diff(edge)):
                i, j = edge[g], edge[g + 1]
                out.add((1 << bits) + g, chunk, i, j - i, a[i:j].tobytes() + b[i:j].tobytes() + X.bits_of(many[i:j]))
        out.add(-1 - chunk, chunk, entries, n, blob + X.bits_of(hot))
        return out.table()

    return send


def _answer_texts(length: int, bits: int):
    width = (length + 7) // 8

    def answer(key, table):
        bucket = key[0].as_py()
        if bucket < 0:
            return table.select(MESSAGE.names).cast(MESSAGE)
        n, blobs, chunks = table.column("n").to_numpy(), table.column("blob").to_pylist(), table.column("chunk").to_numpy()
        if bucket >= 1 << bits:
            return _answer_strings(table, n, blobs)
        m = table.column("at").to_numpy()
        part = lambda t, size, at, of: np.concatenate([np.frombuffer(x, t, j, at(i, j)) for x, i, j in zip(blobs, n.tolist(), of.tolist(), strict=True)])
        entry, fp, name = part(np.int32, 4, lambda i, j: 0, n), part(np.uint64, 8, lambda i, j: 4 * i, n), part(np.uint64, 8, lambda i, j: 12 * i, n)
        s, e = part(np.int64, 8, lambda i, j: 20 * i, m), part(np.int64, 8, lambda i, j: 20 * i + 8 * j, m)
        flags = np.concatenate([np.frombuffer(x, np.uint8, i, 20 * i + 16 * j) for x, i, j in zip(blobs, n.tolist(), m.tolist(), strict=True)])
        texts = np.concatenate([np.frombuffer(x, np.uint8, -1, 21 * i + 16 * j) for x, i, j in zip(blobs, n.tolist(), m.tolist(), strict=True)])
        chunk = np.repeat(chunks, n)
        size = e - s
        text_at = np.cumsum(size) - size
        # Of each context: its claims, its one text, whether it is there more than once.
        order = np.lexsort((1 - (flags & 1), name, fp))
        claim = X.group_starts(fp[order], name[order])
        claims = np.diff(np.append(claim, len(fp)))
        several = (claims > 1) | (np.bitwise_or.reduceat(flags[order], claim) > 1)
        row = (np.cumsum(flags & 1) - 1)[order[claim]]
        group = X.group_starts(fp[order[claim]])
        s, e, size, text_at, home = s[row], e[row], size[row], text_at[row], chunk[order[claim]].astype(np.int64)
        before = np.append(np.concatenate([[0], np.cumsum(size)])[group], len(texts))
        full, some, i = {}, {}, 0
        while i < len(group):
            j = max(i + 1, int(np.searchsorted(before, before[i] + INDEX_BYTES, "right")) - 1)
            rows = np.arange(group[i], group[j] if j < len(group) else len(s))
            i = j
            rows = rows[np.lexsort((s[rows], home[rows]))]
            # Contexts that overlap in their chunk become one segment, so that each position is indexed once.
            a, z, t = s[rows], e[rows], home[rows]
            reach = np.maximum.accumulate(z + (t << 40)) - (t << 40)
            new = np.ones(len(rows), bool)
            new[1:] = (t[1:] != t[:-1]) | (a[1:] > reach[:-1])
            seg = np.cumsum(new) - 1
            low, high = a[new], np.maximum.reduceat(z, np.flatnonzero(new))
            place = np.cumsum(high - low + 1) - (high - low + 1)
            text = np.full(int((high - low + 1).sum()), SEPARATOR, np.uint8)
            at = place[seg] + a - low[seg]
            for x, y, r in zip(at.tolist(), (z - a).tolist(), rows.tolist(), strict=True):
                text[x : x + y] = texts[text_at[r] : text_at[r] + y]
            more = several[rows]
            long = RunLengthIndex(text).matching_statistics((at[more], (z - a)[more])) >= length
            marked = np.concatenate([[0], np.cumsum(long)])
            starts = z - a - length + 1
            got = marked[at + starts] - marked[at]
            for x, y, r, found in zip(at.tolist(), starts.tolist(), rows.tolist(), got.tolist(), strict=True):
                if not found:
                    continue
                for w in order[claim[r] : claim[r] + claims[r]].tolist():
                    if found == y:
                        full.setdefault(int(chunk[w]), []).append(int(entry[w]))
                    else:
                        mask = np.zeros(8 * width, bool)
                        mask[:y] = long[x : x + y]
                        some.setdefault(int(chunk[w]), []).append((int(entry[w]), X.bits_of(mask)))
        out = _Out()
        for c in full.keys() | some.keys():
            whole, marks = full.get(c, []), some.get(c, [])
            out.add(bucket, c, len(whole), len(whole) + len(marks), np.array([*whole, *(m[0] for m in marks)], np.int32).tobytes() + b"".join(m[1] for m in marks))
        return out.table()

    return answer


def _answer_strings(table, n, blobs) -> pa.Table:
    a = np.concatenate([np.frombuffer(x, np.uint64, m) for x, m in zip(blobs, n, strict=True)])
    b = np.concatenate([np.frombuffer(x, np.uint64, m, 8 * m) for x, m in zip(blobs, n, strict=True)])
    many = np.concatenate([X.flags_of(x, m, 16 * m) for x, m in zip(blobs, n, strict=True)])
    order = np.lexsort((b, a))
    start = X.group_starts(a[order], b[order])
    count = np.diff(np.append(start, len(a)))
    bit = np.empty(len(a), bool)
    bit[order] = np.repeat((count > 1) | np.logical_or.reduceat(many[order], start), count)
    edge, out = np.concatenate([[0], np.cumsum(n)]), _Out()
    for i, (g, chunk, at) in enumerate(zip(*(table.column(x).to_pylist() for x in ("bucket", "chunk", "at")), strict=True)):
        if bit[edge[i] : edge[i + 1]].any():
            out.add(g, chunk, at, int(n[i]), X.bits_of(bit[edge[i] : edge[i + 1]]))
    return out.table()


def _cut(length: int, k: int, bits: int, carry: bool):
    width = (length + 7) // 8
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def cut(key, docs, answers):
        docs = docs.sort_by(_ORDER)
        c = _Chunk(docs, length)
        step = np.zeros(len(c.buf) + 1, np.int32)

        def mark(start, stop):
            np.add.at(step, start, 1)
            np.add.at(step, stop, -1)

        rows = list(zip(*(answers.column(x).to_pylist() for x in ("bucket", "at", "n", "blob")), strict=True)) if answers.num_rows else []
        if own := next((r for r in rows if r[0] < 0), None):
            _, entries, n, blob = own
            p, entry = np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int32, n, 8 * n)
            hot, full = X.flags_of(blob, entries, 12 * n), np.zeros(entries, bool)
            one = np.zeros(entries, np.int64)
            one[entry[::-1]] = np.arange(n)[::-1]
            strings, lost = [], None
            for g, at, m, x in rows:
                if 0 <= g < 1 << bits:
                    e = np.frombuffer(x, np.int32, m)
                    full[e[:at]] = True  # all of the context's strings, wherever the chunk has it
                    first, _ = c.contexts(p[one[e[at:]]], k)  # a context with some strings only is there once
                    i, o = np.nonzero(np.unpackbits(np.frombuffer(x, np.uint8, -1, 4 * m).reshape(m - at, width), axis=1))
                    strings.append(first[i] + o)
                elif g >= 1 << bits:
                    if lost is None:
                        hot_at = _hot_starts(c, p[hot[entry]], k)
                        order, start, _, _ = _string_hashes(c, hot_at)
                        lost = np.zeros(len(start), bool)
                    lost[at : at + m] = X.flags_of(x, m)
            mark(*c.contexts(p[full[entry]], k))
            if lost is not None:
                strings.append(hot_at[order[np.repeat(lost, np.diff(np.append(start, len(hot_at))))]])
            if strings:
                s = np.concatenate(strings)
                mark(s, s + length)
        gone = np.cumsum(step[:-1]) > 0
        a, b = runs(gone)
        doc = np.searchsorted(c.off, a, "right") - 1
        n_docs = len(c.ids)
        spans = [[] for _ in range(n_docs)]
        for d, x, y in zip(doc.tolist(), (a - c.off[doc]).tolist(), (b - c.off[doc]).tolist(), strict=True):
            spans[d].append({"start": x, "end": y})
        clean = c.buf[~gone].tobytes()
        size = np.diff(c.off) - 1
        removed = np.bincount(doc, b - a, n_docs).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(size - removed + 1)])
        kept = [clean[edge[i] : edge[i + 1] - 1] for i in range(n_docs)]
        columns = [c.ids, pa.array(size), pa.array(removed), pa.array(np.bincount(doc, minlength=n_docs).astype(np.int64)), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span))]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_bytes", "spans"]
        if carry:
            columns += [pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()), docs.column("carry")]
            names += ["kept_text", "carry"]
        return pa.table(columns, names=names)

    return cut


_ORDER = [("doc_id", "ascending"), ("text", "ascending")]
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, spans array<struct<start:int,end:int>>"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor: int = ANCHOR, carry: bool = False, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_bytes, spans`` (byte positions, ends exclusive), and with ``carry``
    ``kept_text``, without what is left of characters that were cut in two, and the whole input row as the struct ``carry``.
    """
    if not 8 <= anchor < length:
        raise ValueError("an anchor has at least 8 bytes and fewer than a string")
    pairs = id_and_text(docs, id_col, text_col, carry)
    total = text_bytes(pairs)
    bits = bucket_bits(total)
    by_chunk = with_chunk(pairs, chunks_for(total)).groupBy("chunk")
    first = by_chunk.applyInArrow(_send_anchors(length, anchor, bits), MESSAGE_SQL).groupBy("bucket").applyInArrow(_answer_anchors(most_contexts), MESSAGE_SQL)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(_send_texts(length, anchor, bits), MESSAGE_SQL).groupBy("bucket").applyInArrow(_answer_texts(length, bits), MESSAGE_SQL)
    schema = with_carry(RESULT + ", kept_text string", docs) if carry else RESULT
    return by_chunk.cogroup(second.groupBy("chunk")).applyInArrow(_cut(length, anchor, bits, carry), schema)

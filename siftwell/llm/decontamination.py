"""Benchmark decontamination by latent semantic retrieval.

1. Passages.  A text's tokens (runs of letters and digits, lower-cased) fall into blocks of ``BLOCK``; two and four
   consecutive blocks are passages of two sizes, one block apart.  An item longer than the larger size is searched as a whole
   and by segments of at most ``SEGMENT`` tokens, each of which lies wholly in one of the larger passages.
2. TF-IDF over ``BINS`` hashed tokens; document frequencies are counted over all blocks of all documents.
3. Distributed randomised SVD of all passages: every task adds up ``A'(A G)`` for a Gaussian ``G`` of ``RANK`` columns; the
   sums, of fixed size, are added in a tree, and a Nystroem step on the driver gives singular values and vectors.
4. Search: passages and items meet in the latent space, scaled by the singular values; pairs with a cosine of ``COSINE`` are
   candidates.  Items are a stated query set and go out in blocks of ``ITEMS`` at most; every passage meets every item.  A
   candidate goes if its surroundings, those that the next step reads, hold fewer tokens of the item than that step asks for.
   Tokens in a twentieth of all blocks have no latent weight, and those a little rarer hardly any (``FAINT``), so an item of
   which they make ``SURE`` meets all passages without the cosine, by the count of its tokens only.  So does an item of fewer
   than ``SHORTEST`` tokens, which are too small a part of any passage.
5. Check: the longest common subsequence of the item's tokens and the candidate's surroundings.  A pair counts as a leak if
   it covers ``SURE`` of the item, or ``LIKELY`` of it with the item's answer (what follows its last question mark or answer
   mark, else its last fifth) covered by ``ANSWER``.

All passes run over whole texts in Arrow batches; no pairs are shuffled.  A block of items costs each task a table of at most
``2 * ITEMS * BINS`` bytes, 67 MB.

Defined cases: null or empty texts and items never match; an item of fewer than ``SHORTEST`` tokens is matched only as a
whole contiguous run; texts and items of any length are read whole; repeated rows and equal items are reported row by row and
item by item, so ties are all reported, under a null id where theirs is null; an empty table on either side gives an empty
result; other columns play no part and may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import materialize
from .near_dedup import slabs

BLOCK = 12
BINS = 1 << 14
RANK = 80
COSINE = 0.42
#: Logarithm of twenty.
COMMON = 3.0
#: Inverse frequency, after ``COMMON`` is taken off, up to which a token is too faint to be searched by.
FAINT = 0.5
SURE, LIKELY, ANSWER = 0.75, 0.55, 0.6
SHORTEST = 5
ITEMS = 2048
#: Tasks whose sums meet in one group.
LANE = 16
LONG_ITEM = 28
#: Tokens of an item's segment at most: with any beginning, it ends within four blocks.
SEGMENT = 3 * BLOCK

_KEPT = np.zeros(256, bool)
_KEPT[128:] = _KEPT[65:91] = _KEPT[97:123] = _KEPT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ANSWER_MARK = re.compile(r"\?|\banswer\s*:|\ba\s*:", re.I)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all tokens, and where each text's begin."""
    buf, off = B.concat(texts)
    end = int(off[-1])
    kept = np.zeros(end + 2, bool)
    kept[1:-1] = _KEPT[buf[:end]]
    starts = np.flatnonzero(kept[1:-1] & ~kept[:-2])
    ends = np.flatnonzero(kept[1:-1] & ~kept[2:]) + 1
    return B.span_hash(_LOWER[buf], starts, ends - starts), np.searchsorted(starts, off)


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token and text of each block."""
    n = -(-np.diff(first) // BLOCK)
    doc = np.repeat(np.arange(len(n)), n)
    return first[doc] + BLOCK * B.window_offsets(n), doc


def _sum_blocks(x: np.ndarray, doc: np.ndarray, by: int) -> np.ndarray:
    out = x.copy()
    if len(x) > by:
        same = doc[by:] == doc[:-by]
        out[:-by][same] += x[by:][same]
    return out


def _gathered(table: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the tokens' rows of ``table`` by block; the last row of ``table`` is zero."""
    size = np.diff(np.append(at, len(item)))
    out = np.zeros((len(at), table.shape[1]), table.dtype)
    for k in range(BLOCK):
        out += table[np.where(k < size, item[np.minimum(at + k, len(item) - 1)], BINS)]
    return out


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def _scatter(total: np.ndarray, rows: np.ndarray, block: np.ndarray, item: np.ndarray) -> None:
    """Adds ``rows[block]`` to ``total[item]``; ``item`` is sorted.  Frequent items one by one, rare ones rank by rank."""
    start = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    count = np.diff(np.append(start, len(item)))
    for i in np.flatnonzero(count > 16):
        total[item[start[i]]] += rows[block[start[i] : start[i] + count[i]]].sum(0)
    start, count = start[count <= 16], count[count <= 16]
    for k in range(int(count.max(initial=0))):
        start, count = start[count > k], count[count > k]
        total[item[start]] += rows[block[start + k]]


def _frequencies(batches):
    count, blocks = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for part in slabs(batch):
            h, first = tokens(part.column("text"))
            at, _ = _blocks(first)
            if len(at):
                item = (h & np.uint64(BINS - 1)).astype(np.int64)
                order = np.argsort(item.astype(np.uint16), kind="stable")
                item, block = item[order], np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))[order]
                new = np.ones(len(h), bool)
                new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1])
                count += np.bincount(item[new], minlength=BINS)
                blocks += len(at)
    yield pa.record_batch([pa.array(np.append(count, blocks)), pa.array(np.arange(BINS + 1))], names=["n", "bin"])


def _inverse(counts: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, less those of a term in a twentieth of all blocks, which carries nothing: the search has a way of its own for them."""
    return (np.log((counts[-1] + 1.0) / (counts[:-1] + 1.0)) - COMMON).clip(0.0, None).astype(np.float32)


def _tests(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, RANK)).astype(np.float32)


def _range_sums(shared):
    """Each task's ``A'(A G)``: passages of two blocks, rows of unit length."""

    def run(batches):
        idf = shared.value
        table = _with_zero(_tests() * idf[:, None])
        total = np.zeros((BINS, RANK), np.float32)
        for batch in batches:
            for part in slabs(batch, most=1 << 20):
                h, first = tokens(part.column("text"))
                at, doc = _blocks(first)
                if len(at) < 1:
                    continue
                item = (h & np.uint64(BINS - 1)).astype(np.int64)
                y = _sum_blocks(_gathered(table, item, at), doc, 1)
                # The rows' squared lengths, as if no token came twice in a passage: a weight, not a result.
                size = _sum_blocks(np.add.reduceat(idf[item] ** 2, at), doc, 1)
                y /= np.maximum(size, 1e-6)[:, None]
                # A token of block i is in the passages that begin at i and at i - 1.
                back = y.copy()
                if len(at) > 1:
                    same = doc[1:] == doc[:-1]
                    back[1:][same] += y[:-1][same]
                order = np.argsort(item.astype(np.uint16), kind="stable")
                block = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))[order]
                _scatter(total, back, block, item[order])
        total *= idf[:, None]
        for i in range(0, BINS, BINS // 16):
            yield pa.record_batch([pa.array([i]), pa.array([TaskContext.get().partitionId()]), pa.array([total[i : i + BINS // 16].tobytes()])], names=["rows", "lane", "sums"])

    return run


def _add(key, table):
    """Sums of one lane; the lane of the next level holds ``LANE`` of this one's."""
    total = None
    for x in table.column("sums"):
        part = np.frombuffer(x.as_buffer(), np.float32)
        total = part.astype(np.float64) if total is None else total + part
    return pa.table({"rows": [table.column("rows")[0].as_py()], "lane": [key[1].as_py()], "sums": [total.astype(np.float32).tobytes()]}, schema=pa.schema([("rows", pa.int64()), ("lane", pa.int64()), ("sums", pa.binary())]))


def latent_space(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(map, singular, weights)``: rows of ``map`` take hashed tokens to latent coordinates, inverse frequencies and scaling
    included; ``weights`` are plain inverse frequencies, at least a little for every token."""
    spark = docs.sparkSession
    counts = docs.mapInArrow(_frequencies, "n long, bin long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    all_ = np.zeros(BINS + 1, np.int64)
    all_[counts["bin"].to_numpy()] = counts["n"].to_numpy()
    idf = _inverse(all_)
    weights = (np.log((all_[-1] + 1.0) / (all_[:-1] + 1.0)) + 0.1).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    schema = "rows long, lane long, sums binary"
    got, lanes = docs.mapInArrow(_range_sums(shared), schema), docs.rdd.getNumPartitions()
    while True:
        # A group holds the sums of LANE tasks at most, some 5 MB, however many tasks there are.
        got = got.withColumn("lane", F.floor(F.col("lane") / LANE)).groupBy("rows", "lane").applyInArrow(_add, schema)
        lanes = -(-lanes // LANE)
        if lanes <= 1:
            break
    got = got.toPandas()
    z = np.zeros((BINS, RANK))
    for i, x in zip(got["rows"], got["sums"], strict=True):  # one lane, or a few if the plan made more tasks than were counted
        z[i : i + BINS // 16] += np.frombuffer(x, np.float32).reshape(-1, RANK)
    # Nystroem: A'A is near Z (G'Z)^-1 Z'.
    g = _tests().astype(np.float64)
    core = g.T @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    ok = values > max(values.max(), 1e-30) * 1e-9
    if not ok.any():
        return np.zeros((BINS, 1), np.float32), np.zeros(1), weights
    f = z @ (vectors[:, ok] / np.sqrt(values[ok]))
    gram = f.T @ f
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    ok = values > max(values.max(), 1e-30) * 1e-9
    singular = np.sqrt(np.sqrt(values[ok]))  # of A: F'F holds fourth powers
    v = (f @ vectors[:, ok]) / np.sqrt(values[ok])
    return (v / singular * idf[:, None]).astype(np.float32), singular, weights


class Item:
    __slots__ = ("item_id", "tokens", "masks", "answer", "n")

    def __init__(self, item_id: int, text: str):
        self.item_id = item_id
        h, _ = tokens(pa.array([text]))
        self.tokens, self.n = h.tolist(), len(h)
        self.masks: dict[int, int] = {}
        for i, t in enumerate(self.tokens):
            self.masks[t] = self.masks.get(t, 0) | (1 << i)
        marks = list(_ANSWER_MARK.finditer(text))
        tail = len(tokens(pa.array([text[marks[-1].end() :]]))[0]) if marks else 0
        self.answer = tail if 0 < tail < self.n else max(1, self.n // 5)

    def common(self, words: list[int]) -> tuple[int, int]:
        """Lengths of the longest common subsequence with ``words``, of the item and of its answer."""
        full = (1 << self.n) - 1
        v = full
        for w in words:
            m = self.masks.get(w)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        zeros = ~v & full
        return zeros.bit_count(), (zeros >> (self.n - self.answer)).bit_count()

    def leaks(self, words: list[int]) -> tuple[bool, int, bool]:
        if self.n < SHORTEST:
            n = self.n
            found = n > 0 and any(words[i : i + n] == self.tokens for i in range(len(words) - n + 1))
            return found, n if found else 0, found
        got, tail = self.common(words)
        answered = tail >= ANSWER * self.answer
        return got >= SURE * self.n or (got >= LIKELY * self.n and answered), got, answered


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _segments(n: int) -> list[tuple[int, int]]:
    """Where the probes of an item of ``n`` tokens begin and end: the whole, and the segments of one longer than a passage."""
    parts = -(-n // SEGMENT) if n > 4 * BLOCK else 0
    return [(0, n), *((n * i // parts, n * (i + 1) // parts) for i in range(parts))]


def _least(n: int) -> float:
    """Common tokens below which an item of ``n`` tokens can't leak."""
    return n if n < SHORTEST else min(SURE, LIKELY) * n


class _Held:
    """How many tokens of each item occur in the surroundings of a block: what its common subsequence can't exceed."""

    def __init__(self, bins: list[np.ndarray]):
        self.distinct = np.array([len(np.unique(x)) for x in bins])
        # Of each item its tokens' own numbers, and how often the item has them; the last number is for all others.
        most = -(-int(self.distinct.max()) // 64) * 64
        self.number = np.full((BINS + 1, len(bins)), most, np.min_scalar_type(most))
        self.times = np.zeros((len(bins), most), np.int32)
        for i, x in enumerate(bins):
            own, times = np.unique(x, return_counts=True)
            self.number[own, i], self.times[i, : len(own)] = np.arange(len(own)), times
        self.repeats = [[(int(j), int(t[j]) - 1) for j in np.flatnonzero(t > 1)] for t in self.times]
        self.more = np.array([sum(x[1] for x in r) for r in self.repeats])

    def enough(self, token: np.ndarray, first: np.ndarray, last: np.ndarray, m: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether blocks ``first`` to ``last - 1`` of a text hold ``least`` tokens of item ``m``; ``token``: blocks by row; ordered by
        ``m``, then ``first``."""
        out, bits = np.zeros(len(m), np.int64), []
        if not len(m):
            return out > 0
        # What neighbouring ranges of one item share is looked up once.
        fresh = np.ones(len(m), bool)
        fresh[1:] = m[1:] != m[:-1]
        begin = first.copy()
        begin[1:] = np.where(fresh[1:], first[1:], np.maximum(first[1:], last[:-1]))
        size = np.maximum(last - begin, 0)
        stop = np.cumsum(size)
        start = stop - (last - first)
        for word in range(-(-int(self.distinct[m].max()) // 64)):
            has = np.zeros(int(stop[-1]) + 1, np.uint64)  # a bit for each of the item's tokens that the block has
            for a in range(0, len(m), 1 << 13):
                z = min(len(m), a + (1 << 13))
                block = np.repeat(begin[a:z] - (stop[a:z] - size[a:z]), size[a:z]) + np.arange(stop[a] - size[a], stop[z - 1])
                number = self.number[token[block], np.repeat(m[a:z], size[a:z])[:, None]]
                mine = np.uint64(1) << (number & 63).astype(np.uint64)
                mine[number >> 6 != word] = 0
                has[stop[a] - size[a] : stop[z - 1]] = np.bitwise_or.reduce(mine, 1)
            got = np.bitwise_or.reduceat(has, np.stack([start, stop], 1).ravel())[::2]
            out += np.bitwise_count(got)
            bits.append(got)
        good = out + self.more[m] >= least
        for k in np.flatnonzero(good & (out < least)):  # only by tokens that the item has more than once
            good[k] = out[k] + sum(more for j, more in self.repeats[m[k]] if int(bits[j >> 6][k]) >> (j & 63) & 1) >= least[k]
        return good

    def everywhere(self, item: np.ndarray, block: np.ndarray, first: np.ndarray, last: np.ndarray, m: int) -> np.ndarray:
        """For all blocks at once, with surroundings of blocks ``first`` to ``last - 1``; ``block``: that of each token of ``item``."""
        out, own = np.zeros(len(first), np.int64), self.number[:, m].astype(np.int64)[item]
        at = np.flatnonzero(own < self.distinct[m])
        at = at[np.argsort(own[at], kind="stable")]
        bound = np.searchsorted(own[at], np.arange(self.distinct[m] + 1))
        for i in range(int(self.distinct[m])):
            if bound[i] < bound[i + 1]:
                there = np.zeros(len(first) + 1, np.int64)
                there[block[at[bound[i] : bound[i + 1]]] + 1] = 1
                there = np.cumsum(there)
                out += self.times[m, i] * (there[last] > there[first])
        return out


def _search(shared, cosine: float):
    def run(batches):
        table, weights, raw = shared.value
        items = [Item(i, t) for i, t in raw]
        items = [x for x in items if x.n]
        if not items:
            return
        bins = [np.array(x.tokens, np.uint64) & np.uint64(BINS - 1) for x in items]
        held = _Held(bins)
        least, around = (np.array(x) for x in zip(*((_least(x.n), -(-x.n // BLOCK)) for x in items), strict=True))
        probes = [(i, bins[i][low:high]) for i, x in enumerate(items) for low, high in _segments(x.n)]
        latent, of = _unit(np.stack([table[x].sum(0) for _, x in probes])), np.array([i for i, _ in probes])
        long = np.array([len(x) >= LONG_ITEM or len(x) < items[i].n for i, x in probes])
        faint = weights <= COMMON + FAINT + 0.1
        plain = np.array([items[i].n < SHORTEST or faint[x].sum() >= SURE * items[i].n for i, x in enumerate(bins)])
        padded = _with_zero(table)
        groups = [(2, np.flatnonzero(~long & ~plain[of])), (4, np.flatnonzero(long & ~plain[of]))]
        for batch in batches:
            for part in slabs(batch, most=1 << 20):
                h, first = tokens(part.column("text"))
                at, doc = _blocks(first)
                if not len(at):
                    continue
                item = (h & np.uint64(BINS - 1)).astype(np.int64)
                size = np.diff(np.append(at, len(h)))[:, None]
                step = np.arange(BLOCK)[None, :]
                token = np.where(step < size, item[np.minimum(at[:, None] + step, len(h) - 1)], BINS)
                x = _gathered(padded, item, at)
                out: dict[tuple[int, int], list] = {}

                def check(width, b, m, c):
                    for i in np.argsort(-c, kind="stable").tolist():
                        d, k = int(doc[b[i]]), int(m[i])
                        best = out.get((d, k))
                        if best and best[1] >= items[k].n:
                            continue
                        low, high = max(first[d], at[b[i]] - items[k].n), min(first[d + 1], at[b[i]] + BLOCK * width + items[k].n)
                        leak, got, answered = items[k].leaks(h[low:high].tolist())
                        if leak and (best is None or got > best[1]):
                            out[d, k] = [float(c[i]) if best is None else best[0], got, answered]

                block, b0, b1 = np.repeat(np.arange(len(at)), size[:, 0]), np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
                for k in np.flatnonzero(plain).tolist():
                    width = 2 if items[k].n < LONG_ITEM else 4
                    b = np.arange(len(at))
                    low, high = np.maximum(b - around[k], b0), np.minimum(b + width + around[k], b1)
                    count = held.everywhere(item, block, low, high, k)
                    # The fullest surroundings first.
                    b = b[count >= least[k]]
                    b = b[np.argsort(-count[b], kind="stable")]
                    check(width, b, np.full(len(b), k), np.zeros(len(b), np.float32))
                for width, mine in groups:
                    x = _sum_blocks(x, doc, width // 2)
                    if not len(mine):
                        continue
                    near = _unit(x) @ latent[mine].T
                    b, m = np.divmod(np.flatnonzero(near >= cosine), len(mine))
                    c, m = near[b, m], of[mine[m]]
                    if len(near):
                        # Of an item's probes in one passage, the nearest.
                        order = np.lexsort((-c, m, b))
                        order = order[np.concatenate([[True], (np.diff(b[order]) != 0) | (np.diff(m[order]) != 0)])[: len(order)]]
                        b, m, c = b[order], m[order], c[order]
                    order = np.lexsort((b, m))
                    b, m, c = b[order], m[order], c[order]
                    good = held.enough(token, np.maximum(b - around[m], b0[b]), np.minimum(b + width + around[m], b1[b]), m, least[m])
                    b, m, c = b[good], m[good], c[good]
                    check(width, b, m, c)
                ids = part.column("doc_id")
                rows = sorted(out)
                yield pa.record_batch(
                    [ids.take(pa.array([d for d, _ in rows], pa.int64())), pa.array([items[k].item_id for _, k in rows], pa.int64()), pa.array([items[k].n for _, k in rows], pa.int64()), pa.array([out[r][1] for r in rows], pa.int64()), pa.array([out[r][2] for r in rows], pa.bool_()), pa.array([out[r][0] for r in rows], pa.float64())],
                    names=["doc_id", "item_id", "item_tokens", "common", "answered", "cosine"],
                )

    return run


RESULT = "doc_id long, item_id long, item_tokens long, common long, answered boolean, cosine double"


def leaked_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """One row for each document (row) and item found in it: ``doc_id, item_id, item_tokens, common, answered, cosine``.

    The cosine is 0 for items that are searched by their tokens only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text")).filter("text is not null")
    table, _, weights = latent_space(rows.select("text"))
    parts = max(1, -(-items.count() // ITEMS))
    out = None
    for i in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else items
        held = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        found = rows.mapInArrow(_search(spark.sparkContext.broadcast((table, weights, held)), cosine), RESULT)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` without a leaked item.  Rows are judged one by one, by id and text, whether or not others share their
    id or it is null; all columns of ``docs`` come back as they are."""
    row = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(1))
    rows = docs.select(row.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bad = materialize(leaked_items(rows, benchmark, **more).select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    held = docs.select(row.alias("leaked"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    return held.join(bad, "leaked", "left_anti").select("r.*")

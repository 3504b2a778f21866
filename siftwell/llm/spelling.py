"""Spelling variants: words one insertion, deletion or replacement apart, by a trie self-join with active-node sets.

The vocabulary is counted where the texts are (a document's runs are counted at once, then a task's, then all), so what is
shuffled is words, never occurrences.  Its trie is cut by prefix: a prefix under which more than ``SHARD_WORDS`` words lie is an
upper node, and the first prefix of a word that isn't is its shard, of bounded size whatever prefix is common.

* In a shard, level by level, the nodes at distance one of a node (its active nodes) come from its parent's: both go down by
  the same label.  New ones start where words part, at siblings (a replacement) and at a child against its parent (an
  insertion).  Where an insertion can be read in several ways, only the last is followed, so a pair of nodes arises once.
  Pairs of nodes that both end words are emitted.
* Below an upper node the edit at that node leaves distance zero: the rests of both words must be equal.  So the words of all
  shards meet by upper node and rest, in groups of at most one word for each letter and one for none.

Near pairs become two numbers a word in one aggregation, the strongest neighbour among them; roots are found by pointer
jumping, which ends since a form is at least ``RATIO`` times as frequent as its word.

Defined cases: a null text has no words; a null id counts as an empty one where ids are hashed; repeated rows count each.  Runs
are the letters A to Z and U+00C0 to U+00FF, the two signs among the latter included; only A to Z are lower-cased.  Runs of any
length are words, and levels beyond a shard's longest word cost nothing.  Of neighbours that are equally frequent the smallest
is the form.  An empty table gives an empty result; other columns of the input play no part and may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .near_dedup import slabs

#: Words that a shard holds at most.
SHARD_WORDS = 50_000
#: Letters of a prefix that one pass over the vocabulary looks at.
STEP = 6
#: Upper nodes that may be broadcast.
MOST_SENT = 100_000
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Every document's words of which one in so many, by hash, has a letter deleted.
TYPO_RATE = 199
_FLUSH = 200_000


def typo(doc_id: int | None, word: bytes, rate: int = TYPO_RATE) -> bytes:
    """The word (Latin-1) as this document spells it."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, word if word.isascii() else word.decode("latin-1").encode()))
    if h % rate:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(least: int, rate: int):
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)  # all letters are in Latin-1, in which lower() changes A to Z only

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for part in slabs(b):
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    for word, n in Counter(runs.findall(text.encode("latin-1", "replace").lower())).items() if text else ():
                        if len(spelt := typo(i, word, rate)) >= least:
                            counts[spelt] += n
                    if len(counts) > _FLUSH:
                        yield batch(counts)
                        counts.clear()
        if counts:
            yield batch(counts)

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, rate: int = TYPO_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the distinct words of all texts that are long and frequent enough."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_counted(least_letters, rate), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _expand(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, ``counts[i]`` numbers from ``starts[i]`` on; and the i of each."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(of))


class _Level:
    """The nodes one step below those of the level before; ``key`` is the parent and the label, ascending."""

    def __init__(self, parent: np.ndarray, label: np.ndarray, ends: np.ndarray, n_parents: int):
        self.label, self.ends = label, ends
        self.key = parent << 8 | label
        self.first = np.searchsorted(parent, np.arange(n_parents + 1))

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _expand(self.first[nodes], self.first[nodes + 1] - self.first[nodes])

    def find(self, parents: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the children exist, and where."""
        key = parents << 8 | labels
        at = np.searchsorted(self.key, key)
        ok = at < len(self.key)
        ok[ok] = self.key[at[ok]] == key[ok]
        return ok, at


def near_in_shards(words: list[bytes], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``words`` (sorted, distinct) whose words are one edit apart, at or below ``depth`` letters of each."""
    size = np.array([len(w) for w in words], np.int64)
    off = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(words), np.uint8)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def levels():
        live = np.arange(len(words))
        node, n_nodes, d = np.zeros(len(words), np.int64), 1, 0
        while True:
            go = size[live] > d
            live, node = live[go], node[go]
            label = buf[off[live] + d].astype(np.int64)
            new = np.ones(len(live), bool)
            new[1:] = (node[1:] != node[:-1]) | (label[1:] != label[:-1])
            at = np.flatnonzero(new)
            # A word that ends at a node is the first of the node's words.
            level = _Level(node[at], label[at], np.where(size[live[at]] == d + 1, live[at], -1), n_nodes)
            level.seeds = depth[live[at]] <= d + 1
            yield level
            node, n_nodes, d = np.cumsum(new) - 1, len(at), d + 1

    def emit(x_ends: np.ndarray, y_ends: np.ndarray) -> None:
        both = (x_ends >= 0) & (y_ends >= 0)
        if both.any():
            found.append((x_ends[both], y_ends[both]))

    def down(x: np.ndarray, y: np.ndarray, below_x: _Level, below_y: _Level, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        of, child = below_x.children(x)
        label = below_x.label[child]
        if but is not None:
            go = label != but[of]
            of, child, label = of[go], child[go], label[go]
        ok, at = below_y.find(y[of], label)
        return child[ok], at[ok]

    none = np.zeros(0, np.int64)
    it = levels()
    level = next(it)
    replaced, inserted, roots = (none, none), (none, none), np.flatnonzero(np.full(1, len(words) > 0 and depth.min() <= 0))
    of, child = level.children(roots)
    fresh = child, roots[of]
    seeds = roots
    while len(level.label):
        below = next(it)
        # Siblings below nodes that may start pairs: each child with those before it.
        of, child = level.children(seeds)
        mine, other = _expand(level.first[seeds][of], child - level.first[seeds][of])
        x, y = down(*replaced, level, level)
        replaced = np.concatenate([x, child[mine]]), np.concatenate([y, other])
        emit(level.ends[replaced[0]], level.ends[replaced[1]])
        older = down(*inserted, below, level)
        newer = down(*fresh, below, level, level.label[fresh[0]])
        inserted = np.concatenate([older[0], newer[0]]), np.concatenate([older[1], newer[1]])
        emit(below.ends[inserted[0]], level.ends[inserted[1]])
        seeds = np.flatnonzero(level.seeds)
        of, child = below.children(seeds)
        fresh = child, seeds[of]
        emit(below.ends[fresh[0]], level.ends[fresh[1]])
        level = below
    return (np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])) if found else (none, none)


def _shards(table: pa.Table) -> pa.Table:
    """Near pairs of one bin of shards, each in both directions."""
    rows = sorted((w.encode("latin-1"), n, d) for w, n, d in zip(table["word"].to_pylist(), table["n"].to_pylist(), table["depth"].to_pylist(), strict=True))
    x, y = near_in_shards([w for w, _, _ in rows], np.array([d for _, _, d in rows], np.int64))
    word, n = pa.array([w.decode("latin-1") for w, _, _ in rows], pa.string()), pa.array([n for _, n, _ in rows], pa.int64())
    a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
    return pa.table({"word": word.take(a), "near": word.take(b), "near_n": n.take(b)})


def placed(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """Adds ``depth``: letters of the prefix that is the word's shard; all shorter prefixes are upper nodes."""
    depth = F.lit(0 if words.count() <= most else 1)
    cur, base = words.withColumn("depth", depth), 0
    if words.limit(1).count() == 0 or cur.first().depth == 0:
        return cur
    while True:
        at = cur.filter((F.col("depth") == base + 1) & (F.char_length("word") > base)).select("word", F.explode(F.sequence(F.lit(base + 1), F.least(F.char_length("word"), F.lit(base + STEP)))).alias("d"))
        prefixes = at.select("word", F.substring("word", 1, F.col("d")).alias("prefix"))
        heavy = materialize(prefixes.groupBy("prefix").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("prefix"), "upper")
        n = heavy.count()  # at most STEP times the words over most
        if not n:
            return cur
        up = prefixes.join(F.broadcast(heavy) if n <= MOST_SENT else heavy, "prefix").groupBy("word").agg(F.count("*").cast("int").alias("more"))
        cur = materialize(cur.join(up, "word", "left").select("word", "n", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "placed")
        base += STEP


def _across(words: DataFrame) -> DataFrame:
    """Near pairs whose edit is at an upper node: the rests after it are equal."""
    w = words.filter("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.char_length("word")))).alias("d"))
    here, rest = F.substring("word", F.col("d") + 1, F.lit(1)), lambda skip: F.substring("word", F.col("d") + 1 + skip, F.char_length("word"))
    side = lambda edited, after: F.struct(F.concat(F.substring("word", F.lit(1), F.col("d")), F.lit("\0"), after).alias("key"), F.lit(edited).alias("edited"), here.alias("here"))
    sides = F.array_compact(F.array(F.when(F.col("d") < F.char_length("word"), side(True, rest(1))), side(False, rest(0))))
    groups = w.select("word", "n", F.explode(sides).alias("s")).groupBy("s.key").agg(F.collect_list(F.struct("word", "n", F.col("s.edited").alias("edited"), F.col("s.here").alias("here"))).alias("m"))
    pairs = groups.filter("size(m) > 1").select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b"))
    both = (F.col("a.edited") | F.col("b.edited")) & (F.col("a.here") != F.col("b.here"))
    return pairs.filter(both).select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def near_pairs(words: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """``(word, near, near_n)`` for each ordered pair of words of ``(word, n)`` that are one edit apart."""
    at = materialize(placed(words, most), "words")
    bins = max(1, -(-2 * at.count() // most))
    shards = at.filter(F.col("depth") <= F.char_length("word")).withColumn("bin", F.pmod(F.xxhash64(F.substring("word", F.lit(1), F.col("depth"))), F.lit(bins)).cast("int"))
    return shards.groupBy("bin").applyInArrow(_shards, "word string, near string, near_n long").unionByName(_across(at))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for words that have a form, by pointer jumping."""
    cur = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        cur = materialize(cur.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if cur.filter("moved").limit(1).count() == 0:
            return cur.select("word", "root")
        cur = cur.select("word", "root")


def spelling_variants(docs: DataFrame, most: int = SHARD_WORDS, ratio: int = RATIO, **how) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the vocabulary."""
    words = materialize(vocabulary(docs, **how), "vocabulary")
    best = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    top = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    out = words.join(best, "word", "left").withColumn("top", top)
    out = materialize(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.near").alias("form"), (-F.col("top.less")).alias("form_n")), "near")
    return out.join(_roots(out.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))

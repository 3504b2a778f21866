import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import prefix_trie as module
from siftwell.llm.prefix_trie import Louds, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, `k 1` string"


def brute(rows, hashes, graft=True):
    """``rows`` (conv_id, turn, role, text); ``hashes``: what orders turns of equal numbers."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, hashes[role or "", text or ""], (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + t[h:] if graft else t
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(node))))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), sum(map(leaf, below)),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA)


def check(spark, rows, graft=True, **how):
    df = table(spark, rows)
    r, t = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = {(x[0], x[1]): (x[2], x[3]) for x in df.select(r, t, F.xxhash64(r, t), F.xxhash64(F.lit(1), t, r)).distinct().collect()}
    got = conversation_trie(df, graft, **how)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, hashes, graft)


def some(seed, n=60, longest=9):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 3 * n), n):
        for turn in range(r.randint(1, longest)):
            rows.append((c, turn, r.choice(["user", "assistant", "", None]), r.choice(["a", "b", "é" * 3, "", None]) if turn < 3 else r.choice(["x", "yy"])))
    return rows


@pytest.mark.parametrize("seed,how", [(0, {}), (1, {"shard_turns": 1, "upper_nodes": 1 << 40}), (2, {"shard_turns": 6, "upper_nodes": 1 << 40}), (3, {"shard_turns": 4, "upper_nodes": 8}), (4, {"shard_turns": 30})])
def test_against_brute_force(spark, seed, how):
    check(spark, some(seed), **how)


def test_bands_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 2)
    monkeypatch.setattr(module, "ENDS", 2)
    rows = [(c, t, "u", f"t{t}" if t < 30 - c % 3 else f"c{c}") for c in range(0, 60, 5) for t in range(40)]
    check(spark, rows, False, shard_turns=1, upper_nodes=100)
    check(spark, rows + [(1000, t, None, "only") for t in range(50)], shard_turns=10)


def test_odd_rows(spark):
    rows = [(None, 0, "u", "no conversation"), (None, None, None, None), (5, None, "u", "first"), (5, None, "u", "first"), (5, 0, None, None), (5, 0, "", ""), (5, 1, "u", "x"), (5, 1, "u", "y"), (5, 1, "a", "z"), (5, -1, "u", "long " * 50_000)]
    rows += [(c, t, "u", "same") for c in range(6, 16) for t in range(2)] * 2  # repeated rows
    rows += [(c, 0, "u", "") for c in range(20, 40)] + [(-3, 0, "u", "below"), (-5, 0, "u", "base"), (2**62, 0, "u", "far")]
    check(spark, rows)
    check(spark, rows, False)


def test_empty(spark):
    assert conversation_trie(table(spark, [])).collect() == []
    assert conversation_trie(table(spark, [(None, 1, "u", "x")])).collect() == []


def test_hot_conversation_is_numbered_by_many_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 7).otherwise(F.col("id") % 500 * 5).alias("conv_id"), (20_000 - F.col("id")).alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    n = module.numbered(rows)
    assert n.filter("conv_id = 7").groupBy("conv_id").agg(F.count("*"), F.countDistinct("place"), F.max("place")).first()[1:] == (15_000, 15_000, 14_999)
    first = rows.filter("conv_id = 7").orderBy("turn").first().text
    assert n.filter(F.col("h1") == F.xxhash64(F.lit("u"), F.lit(first))).first().place == 0


@pytest.mark.parametrize("seed", range(8))
def test_louds(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 60))
    parent = np.array([int(r.integers(-1, i)) if i and r.random() < 0.9 else -1 for i in range(n)])
    names = r.permutation(n)
    parent, label = np.where(parent[names.argsort()] < 0, -1, names[parent[names.argsort()]]), r.integers(0, 9, n)
    trie = Louds(parent, label)
    p = trie.parents()
    assert sorted(trie.order) == list(range(n)) and all((parent[trie.order[i]] == -1) == (p[i] == -1) and (p[i] == -1 or trie.order[p[i]] == parent[trie.order[i]]) for i in range(n))
    assert trie.n_bits == 2 * n + 1 and (np.diff(p) >= 0).all() and np.array_equal(trie.labels, label[trie.order])
    value = r.integers(0, 100, n)
    want = value.copy()
    for i in range(n):
        at = parent[i]
        while at >= 0:
            want[at] += value[i]
            at = parent[at]
    assert np.array_equal(trie.rollup(value[trie.order]), want[trie.order])

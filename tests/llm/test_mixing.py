import math
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwell.llm.mixing import mix_by_quality, mix_sources

SCHEMA = "doc_id long, text string, source string, target int"


def brute_targets(sizes, weights, most):
    """Water filling by repeated sharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def corpus(seed, n=600):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([1, 3, 10, 30, 200])), r.choice(["a"] * 10 + ["b", "é", "c", "d", None]), 1) for i in range(n)] + [(n, None, "a", 0), (n + 1, "", "z", 0), (None, "x y", "a", 0), (3, "w w", "b", 0)]


@pytest.mark.parametrize("seed,bins", [(1, 4096), (2, 3), (3, 64)])
def test_targets_and_draw(spark, seed, bins):
    rows = corpus(seed)
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), bins=bins).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(sizes, (1, 2, 3), 3)
    taken, cut = {}, {}
    for x in got:
        assert x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source])
        assert x.taken <= 3 * x.size
        # Whole documents, but for the last one drawn of a source.
        assert x.size * x.epochs <= x.taken <= x.size * (x.epochs + x.drawn)
        taken[x.source] = taken.get(x.source, 0) + x.taken
        cut[x.source] = cut.get(x.source, 0) + (x.taken < x.size * (x.epochs + x.drawn))
    assert max(cut.values()) <= 1
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1.001


def test_one_document_larger_than_the_rest(spark):
    rows = [(i, "w " * (5000 if i == 7 else 10), "a" if i < 100 else "b", 0) for i in range(1100)] + [(i, "w", "c", 0) for i in range(1100, 1103)]
    for seed in range(4):
        got = mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 5, 1), seed=seed).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect()
        assert all(abs(x.n - x.t) < 1.001 for x in got)


def test_the_drawn_have_the_smallest_keys_and_reruns_agree(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, SCHEMA)
    a = {tuple(x) for x in mix_sources(df, bins=7).select("doc_id", "size", "taken").collect()}
    b = {tuple(x) for x in mix_sources(df.repartition(5), bins=4096).select("doc_id", "size", "taken").collect()}
    assert a == b


def test_weights_matter(spark):
    rows = [(i, "w " * 10, "a" if i % 4 else "b", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(df, weights=(1, 1), quality=F.when(F.col("doc_id") % 8 < 4, 1.0).otherwise(0.25)).filter("source = 'a' and drawn").groupBy(F.expr("doc_id % 8 < 4").alias("good")).count().collect()
    n = {x.good: x["count"] for x in got}
    assert n[True] > 1.5 * n[False]


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_draw(rows, rest):
    """The documents with the smallest keys, until their sum reaches the rest, and the words that each gives."""
    total, drawn = 0, {}
    for x in sorted(rows, key=lambda x: (x.key, x.doc_id is None, x.doc_id or 0, x.size)):
        if total >= rest:
            break
        drawn[x] = min(x.size, math.ceil(rest - total))
        total += x.size
    return drawn


@pytest.mark.parametrize("bins", [2, 8, 4096])
def test_draw_against_brute_force(spark, bins):
    """Of each source exactly the documents with the smallest keys are drawn, and the keys are those of the method."""
    r = random.Random(bins)
    rows = [(i if i % 4 else None, f"{i} " + "w " * r.choice([1, 5, 40]), r.choice("aaaaab"), r.random() + 0.1) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mix_sources(df, bins=bins, quality=F.col("q"), carry=True).collect()
    for s in {x.source for x in got}:
        mine = [x for x in got if x.source == s]
        want = brute_draw(mine, mine[0].target - mine[0].epochs * mine[0].source_size)
        assert {x: x.taken - x.size * x.epochs for x in mine if x.drawn} == want
    # -ln(u) = key * w is exponential: its mean is 1, and its median ln 2.
    e = sorted(x.key * x.carry.q for x in got)
    assert abs(sum(e) / len(e) - 1) < 0.12 and abs(e[len(e) // 2] - math.log(2)) < 0.1


def test_null_ids_are_sampled(spark):
    """Rows without an id draw keys apart, equal texts too, and what is drawn doesn't depend on the size."""
    rows = [(None, "w " * (1 + i % 50), "a" if i % 2 else "b", 0) for i in range(2000)] + [(None, "same text", "b", 0)] * 500
    got = mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 3), quality=F.lit(1.0)).filter("source = 'a'").collect()
    drawn, left = [x.size for x in got if x.drawn], [x.size for x in got if not x.drawn]
    assert len(drawn) > 100 and len(left) > 100 and abs(sum(drawn) / len(drawn) - sum(left) / len(left)) < 5
    same = mix_sources(spark.createDataFrame([(None, "same text", x, 0) for x in "ab" for _ in range(500)], SCHEMA), weights=(1, 3), quality=F.lit(1.0)).filter("source = 'a'").collect()
    assert 0 < sum(x.drawn for x in same) < 500 and len({x.key for x in same}) > 490


def test_weights_are_quality_scores(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        t = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30)]
        rows.append((i, " ".join(t if i % 2 else [x.upper() + "###" for x in t]), "a" if i % 4 < 2 else "b", 0))
        labels.append((i, i % 2, 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_by_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), weights=(1, 3)).filter("source = 'a'").collect()
    good, bad = ([x.drawn for x in got if x.doc_id % 2 == k] for k in (1, 0))
    assert sum(good) > 3 * sum(bad) and len(good) == len(bad) == 150
    again = mix_by_quality(docs.repartition(3), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"), weights=(1, 3)).filter("source = 'a'").collect()
    assert {tuple(x) for x in got} == {tuple(x) for x in again}

import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwell.llm import quality_rules as module
from siftwell.llm.quality_rules import FLOOR, P, base_statistics, chi2_quantile, quality_rules, robust_scatter, vector

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    hit = [False] * n
    for i in range(n - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            hit[i : i + 8] = [True] * 8
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


TEXTS = [None, "", " \n\t", "one", "a b\na b\n\n\na b\r", "x " * 30, "é😀 #*$%&|<> \x1f\xa0y", "\n \nq\n", "w1 w2 w3 w4 w5 w6 w7 w8 " * 2 + "tail", "a\x0bb\x0cc", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 x 3 4 5 6 7 8 9 1"]


def test_base_statistics(spark):
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice(["a", "b", " ", " ", "\n", "#", "c"]) for _ in range(r.randint(0, 400))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, words long")
    for x in base_statistics(df).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(x.text), repr(x.text)


def test_plan_is_native(spark):
    df = spark.createDataFrame([("a", "en", "s", 1)], "text string, lang string, source string, doc_id long")
    plan = quality_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def numpy_scatter(x, h=0.75, steps=module.STEPS):
    """The same estimator without bins: coordinatewise start only, exact subsets."""
    med = np.median(x, 0)
    mad = np.maximum(1.4826 * np.median(np.abs(x - med), 0), FLOOR)
    mean, cov = med, np.diag(mad**2)
    floor = np.diag(np.square(FLOOR))
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(steps):
        near = np.argsort(d2(mean, cov + floor))[: int(np.ceil(h * len(x)))]
        mean, cov = x[near].mean(0), np.cov(x[near].T, bias=True)
    near = d2(mean, cov + floor) <= chi2_quantile(0.975, P) * module._consistency(h)
    return x[near].mean(0), np.cov(x[near].T, bias=True) * module._consistency(0.975) + floor


def test_scatter_is_near_the_exact_one(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(P, P)) * 0.3 + np.eye(P)
    x = rng.normal(size=(900, P)) @ mix + 3
    x[:90] += 25
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"x{i} double" for i in range(P)))
    g = robust_scatter(rows).first()
    mean, cov = numpy_scatter(x)
    low = np.zeros((P, P))
    for i in range(P):
        for j in range(i + 1):
            low[i, j] = g[f"l_{i}_{j}"]
    assert np.allclose([g[f"m_{i}"] for i in range(P)], mean, atol=0.1)
    assert np.allclose(low @ low.T, cov, rtol=0.2, atol=0.15)


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    clean = [" ".join(word() for _ in range(int(r.lognormvariate(5, 0.7)) + 20)) for _ in range(400)]
    noisy = [" ".join(word() + "###" for _ in range(120)) for _ in range(20)]
    looped = ["a b c d e f g h " * 20] * 5
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, 7) for i, t in enumerate(clean + noisy + looped + [None, "short text"])]
    rows += [(9000 + i, t, "xx", "rare", 7) for i, t in enumerate(clean[:5] + noisy[:1])] + [(None, clean[0], "en", "s", 7), (1, clean[1], "en", "s", 7)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, grp int")).collect()}
    assert sum(got[i].kept for i in range(400)) >= 395
    assert not any(got[400 + i].kept for i in range(20))
    assert all(got[420 + i].base_failed and not got[420 + i].kept for i in range(7))
    assert all(got[9000 + i].kept for i in range(5))
    again = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, grp int").repartition(7)).collect()}
    assert again == {k: x.kept for k, x in got.items()}
    assert sum(map(len, [rows])) == len(rows)


def test_verdicts_against_an_exact_estimate(spark):
    """Of each language and source: the vectors, the estimate from exact subsets and the cut, all by numpy."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    rows = []
    for i in range(1500):
        t = [word() for _ in range(int(r.lognormvariate(4.5, 0.6)) + 20)]
        if i % 25 == 0:
            t = [x + "#$" for x in t]
        elif i % 25 == 1:
            t = [x * 8 for x in t]
        elif i % 25 == 2:
            t = ["the same line again\n"] * 30 + t
        rows.append((i, " ".join(t), "en" if i % 3 else "de", "s"))
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    names = {i: lang for i, _, lang, _ in rows}
    lines = {i: len([x for x in t.split("\n") if WORD.search(x)]) for i, t, _, _ in rows}
    same = 0
    for lang in ("en", "de"):
        mine = [x for x in got if names[x.doc_id] == lang and not x.base_failed]
        x = np.array([[np.log(y.n_words + 1), np.log((y.word_chars + 1) / (y.n_words + 1)), np.log1p(10 * y.n_symbols / (y.n_words + 1)), np.log1p(10 * y.n_dup_lines / (lines[y.doc_id] + 1)), np.log1p(10 * y.n_repeat_words / (y.n_words + 1))] for y in mine])
        mean, cov = numpy_scatter(x)
        d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        same += sum((d <= chi2_quantile(module.CUT, P)) == y.kept for d, y in zip(d2, mine, strict=True))
    sound = [x for x in got if not x.base_failed]
    assert same >= 0.99 * len(sound) and 60 <= sum(not x.kept for x in sound) <= 250
    assert all(x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) and not (x.base_failed and x.kept) for x in got)


def test_small_tables_are_judged_and_repeated_lines_alone_reject(spark):
    r = random.Random(2)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows = [(i, text(r.randint(60, 90)), "en", "s") for i in range(30)]
    rows.append((91, " ".join(x + "###" for x in text(70).split()), "en", "s"))
    rows += [(95, text(70), None, None), (96, text(80), None, None)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i].kept for i in range(30)) >= 29 and not got[91].kept and got[91].distance > 0 and got[95].kept and got[96].kept and got[95].distance is not None
    assert (np.log1p(10) / FLOOR[3]) ** 2 > chi2_quantile(module.CUT, P)


def test_very_long_text(spark):
    rows = [(1, "word " * 200_000, "en", "s"), (2, " ".join(f"w{i}" for i in range(100_000)), "en", "s")]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert (got[1].n_words, got[1].n_repeat_words, got[1].base_failed) == (200_000, 200_000, True)
    assert (got[2].n_words, got[2].n_repeat_words, got[2].base_failed) == (100_000, 0, False)


def test_chi2():
    assert chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)
    assert chi2_quantile(0.5, 2) == pytest.approx(1.38629, abs=1e-4)


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []

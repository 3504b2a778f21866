import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftwell.llm.spelling import near_in_shards, near_pairs, spelling_variants

LETTERS = "abcçÿÀß÷"


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w, c in n.items():
        near = [x for x in n if one_apart(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = [c, len(near), best if best and n[best] >= 5 * c else None]
    for w, x in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        x += [n[x[2]] if x[2] else None, root]
    return {w: tuple(x) for w, x in out.items()}


@pytest.mark.parametrize("seed", range(30))
def test_shards(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("ab" if seed % 2 else "abc") for _ in range(r.randint(1, 7))).encode() for _ in range(r.randint(0, 90))})
    prefix = seed % 3 if seed % 5 else 0
    depth = np.full(len(words), prefix, np.int64)
    x, y = near_in_shards(words, depth)
    got = Counter(frozenset((words[i], words[j])) for i, j in zip(x, y))
    want = {frozenset((a, b)) for a in words for b in words if a < b and one_apart(a, b) and a[:prefix] == b[:prefix] and len(a) >= prefix and len(b) >= prefix}
    # Pairs that can only be read as an edit before the prefix ends, though both have it, belong to an upper node.
    edit = lambda a, b: next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    assert set(got) == {p for p in want if edit(*sorted(p, key=len)) >= prefix} and set(got.values()) <= {1}


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
def test_pairs_over_shards(spark, most):
    r = random.Random(most)
    words = sorted({"ab" * r.randint(0, 9) + "".join(r.choice(LETTERS) for _ in range(r.randint(1, 5))) for _ in range(160)})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter((x.word, x.near, x.near_n) for x in near_pairs(df, most).collect())
    assert set(got) == {(a, b, words.index(b) + 1) for a in words for b in words if one_apart(a, b)} and set(got.values()) <= {1}


@pytest.mark.parametrize("most", [5, 50_000])
def test_query_against_brute_force(spark, most):
    r = random.Random(5)
    base = ["".join(r.choice(LETTERS) for _ in range(r.randint(6, 8))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 40)):
            w = list(r.choice(base[: r.randint(1, 12)]))
            if r.random() < 0.35:
                w[r.randrange(len(w))] = r.choice(LETTERS)
            words.append("".join(w).upper() if r.random() < 0.1 else "".join(w))
        rows.append((i - 50, r.choice([" ", "1", "ž", "😀", "\0"]).join(words)))
    rows += [(None, None), (None, "abcabc " * 30), (7, ""), (7, "abcabc abcabd"), (7, "abcabc abcabd"), (8, "é" * 40_000 + " " + "é" * 39_999)] * 3
    rows += [(i, "É" * 50 + " × ÷×÷×÷×") for i in range(6)]
    rows += [(9000 + i, w) for w, n in (("ccccccc", 400), ("ccccccb", 60), ("cccccab", 9)) for i in range(n)]
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "doc_id long, text string, word string, n int")
    got = {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in spelling_variants(df, most=most).collect()}
    want = brute(rows)
    assert got == want and sum(1 for x in want.values() if x[2]) > 20 and any(x[4] != x[2] for x in want.values() if x[2])


def test_empty(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect() == []

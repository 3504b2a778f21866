import random
import re

import pytest

from siftwell.llm import near_dedup as module
from siftwell.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 63), (1 << 63) if d is None else d)
    return sorted([(d, len(sets[i]), None if low[find(i)] == 1 << 63 else low[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def edited(r, w, rate):
    return [x if r.random() > rate else r.choice("pqrstuv") * 3 + str(r.randint(0, 99)) for x in w]


def corpus(seed, groups=25, size=6, hot=0):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(1, 150))]
        for _ in range(r.randint(1, size)):
            w = edited(r, base, r.choice([0, 0.01, 0.03, 0.1]))
            rows.append(" ".join(x.upper() if r.random() < 0.2 else x for x in w))
    base = [f"h{r.randint(0, 3000)}" for _ in range(140)]
    rows += [" ".join(edited(r, base, r.random() * 0.12)) for _ in range(hot)]
    r.shuffle(rows)
    return list(enumerate(rows)) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "ONE"), (None, rows[0]), (None, "alone and null"), (3, rows[3]), (3, "x y z other text of id three")]


@pytest.mark.parametrize("seed,n,hot", [(1, 4, 0), (2, 5, 0), (3, 4, 160)])
def test_matches_brute_force(spark, monkeypatch, seed, n, hot):
    if hot:
        monkeypatch.setattr(module, "SMALL", 8)
        monkeypatch.setattr(module, "BLOCK", 16)
    rows = corpus(seed, hot=hot)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, k int")
    got = near_duplicates(df, shingle=n).collect()
    want = brute(rows, n, 80)
    have = sorted([(x.doc_id, x.n_shingles, x.component_id) for x in got], key=str)
    assert len(have) == len(want)
    assert sum(a == b for a, b in zip(have, want, strict=True)) >= 0.995 * len(want)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got if x.doc_id is not None and x.component_id is not None)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def form_texts(seed, pairs=600):
    """Documents of one form: 160 words that all share and 40 of their own, of which both of a pair share 18 (0.802 alike)."""
    r = random.Random(seed)
    form = [f"f{i}" for i in range(160)]
    rows = []
    for i in range(pairs):
        both = [f"b{i}x{j}" for j in range(18)]
        for side in "lr":
            w = form + both + [f"{side}{i}x{j}" for j in range(22)]
            r.shuffle(w)
            rows.append((2 * i + (side == "r"), " ".join(w)))
    return rows


@pytest.mark.parametrize("medium", [0, module.MEDIUM])
def test_pairs_among_form_texts(spark, monkeypatch, medium):
    """By branching, and by comparing the mixed nodes exhaustively."""
    monkeypatch.setattr(module, "SMALL", 8)
    monkeypatch.setattr(module, "MEDIUM", medium)
    got = near_duplicates(spark.createDataFrame(form_texts(1), "doc_id long, text string"), shingle=1).collect()
    assert all(x.component_id in (x.doc_id, x.doc_id - x.doc_id % 2) for x in got)
    assert sum(x.doc_id % 2 and x.component_id == x.doc_id - 1 for x in got) >= 0.995 * 600

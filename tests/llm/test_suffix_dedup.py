import random

import numpy as np
import pytest

from siftwell.llm import suffix_dedup as module
from siftwell.llm.run_length_index import SEPARATOR, RunLengthIndex
from siftwell.llm.suffix_dedup import suffix_dedup


@pytest.mark.parametrize("seed", range(30))
def test_matching_statistics(seed):
    r = random.Random(seed)
    alphabet = b"ab" if seed % 2 else b"abcdef\x00\xe9"
    base = bytes(r.choice(alphabet) for _ in range(40))
    docs = [base[r.randint(0, 20) : r.randint(20, 40)] + bytes(r.choice(alphabet) for _ in range(r.randint(0, 9))) for _ in range(12)] + [b"a" * 25]
    text = b"".join(d + bytes([SEPARATOR]) for d in docs)
    got = RunLengthIndex(np.frombuffer(text, np.uint8)).matching_statistics()
    place = [(i, j) for i, d in enumerate(docs) for j in range(len(d) + 1)]
    for x, (i, j) in zip(got, place, strict=True):
        own = docs[i][j:]
        best = 0
        for k, d in enumerate(docs):
            for m in range(len(d)):
                if (k, m) != (i, j):
                    n = 0
                    while n < len(own) and m + n < len(d) and own[n] == d[m + n]:
                        n += 1
                    best = max(best, n)
        assert x == best


def brute(rows, length):
    count, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for j in range(len(t) - length + 1):
            count[t[j : j + length]] = count.get(t[j : j + length], 0) + 1
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if count[t[j : j + length]] > 1:
                gone[j : j + length] = True
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), n, bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    letters = "abcdefgh é\n日"
    passages = ["".join(r.choice(letters) for _ in range(r.randint(20, 150))) for _ in range(6)]
    rows = []
    for i in range(160):
        t = ""
        for _ in range(r.randint(0, 4)):
            t += r.choice(passages)[r.randint(0, 5) :] if r.random() < 0.6 else "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        rows.append((i, t))
    return rows + [(200, None), (201, ""), (202, "a" * 300), (203, "xy" * 90), (None, rows[0][1]), (5, rows[5][1]), (204, rows[9][1] + rows[9][1])]


@pytest.mark.parametrize("chunks,most", [(1, 1000), (7, 1000), (7, 3)])
def test_matches_brute_force(spark, monkeypatch, chunks, most):
    monkeypatch.setattr(module, "chunks_for", lambda total: chunks)
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    got = suffix_dedup(df, length=40, anchor=9, carry=True, most_contexts=most).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept_bytes)) for x in got), key=str) == brute(rows, 40)
    assert all(x.carry.bucket == "x" and x.carry.doc_id == x.doc_id for x in got)
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed for x in got)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts_and_odd_columns(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghij ") for _ in range(1_500_000))
    rows = [(1, long, 1), (2, "x" * 100 + long[700_000:700_900] + "y" * 100, 2), (3, "z" * 1_000_000, 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a b` int")
    got = {x.carry["a b"]: (x.doc_id, x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup(df, carry=True).collect()}
    assert got == {1: (1, 1_500_000, 900, 1), 2: (2, 1100, 900, 1), 3: (3, 1_000_000, 1_000_000, 1), 4: (None, 0, 0, 0)}


def test_the_index_is_the_transform_in_runs():
    text = np.frombuffer(b"banana\xffbandana\xff", np.uint8)
    index = RunLengthIndex(text)
    assert index.lengths.sum() == len(text) == len(index.transform()) and len(index.letters) < len(text)
    assert sorted(index.transform().tolist()) == sorted(text.tolist())
    copied = index.matching_statistics((np.array([7]), np.array([7])))
    assert copied[7:14].tolist() == [7, 6, 5, 4, 3, 2, 1] and index.matching_statistics()[7] == 3

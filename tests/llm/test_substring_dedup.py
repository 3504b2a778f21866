import hashlib
import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from siftwell.llm import substring_dedup as module
from siftwell.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, out = {}, {}
    big = 1 << 63
    parsed = [(big if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in parsed:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, big), i)
    for i, w in parsed:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.setdefault(i, []).append((len(w), sum(gone), " ".join(a for a, b in zip(w, gone) if not b)))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed):
    r = random.Random(seed)
    vocab = ["a", "é", "wörd", "z" * 30, "x,", " ", "日本語テキスト", "b" * 8, "b" * 9, "b" * 16]
    passage = [" ".join(r.choice(vocab) for _ in range(r.randint(12, 60))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(passage) if r.random() < 0.5 else "".join(r.choice(vocab) + r.choice([" ", "\n", "\t\v", "  "]) for _ in range(r.randint(0, 40))))
        rows.append((i * 7 % 151, r.choice(["", " ", "\n"]).join([" ", *parts])))
    return rows + [(500, None), (501, ""), (502, " \n "), (None, rows[0][1]), (None, passage[0]), (503, rows[3][1]), (503, rows[3][1]), (-4, passage[1]), (504, passage[1] * 50), ((1 << 63) - 1, passage[1]), ((1 << 63) - 1, "\n".join(passage))]


@pytest.mark.parametrize("window", [10, 7])
@pytest.mark.parametrize("chunks", [1, 9])
def test_matches_brute_force(spark, monkeypatch, window, chunks):
    monkeypatch.setattr(module, "chunks_for", lambda total: chunks)
    rows = corpus(window)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int")
    got = {}
    for x in substring_dedup(df, window=window).collect():
        got.setdefault((1 << 63) if x.doc_id is None else x.doc_id, []).append((x.n_words, x.n_removed, x.kept_text))
        assert sum(s.end - s.start for s in x.spans) == x.n_removed
    assert {k: sorted(v) for k, v in got.items()} == brute(rows, window)


def test_chains_settle_the_inside_of_long_repeats(spark):
    """Of a copy of a long text, only the windows at the two ends are left to be matched one by one."""
    r = random.Random(4)
    base = [f"w{r.randint(0, 99999)}" for _ in range(400)]
    table = pa.table({"doc_id": [1, 2, 3], "text": [" ".join(base), " ".join(["x", "y", *base[3:390], "z"]), None]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    sent = module._send_blocks(25, 4)([pa.scalar(0)], table)
    rows = sent.to_pylist()
    answers = [module._answer_blocks([pa.scalar(b)], sent.filter(pc.equal(sent["bucket"], b))) for b in sorted({x["bucket"] for x in rows})]
    windows = module._send_windows(50, 25, 4)([pa.scalar(0)], table, pa.concat_tables(answers))
    own = next(x for x in windows.to_pylist() if x["bucket"] < 0)
    n = own["n"]
    cand, chained = module.X.flags_of(own["blob"], n), module.X.flags_of(own["blob"], n, (n + 7) // 8)
    of_copy = slice(400, n)
    assert not chained[:400].any() and chained[of_copy].sum() >= 387 - 2 * 50
    assert not (cand & chained).any() and cand[of_copy].sum() <= 2 * 50


def test_very_long_texts(spark):
    r = random.Random(6)
    long = [f"w{r.randint(0, 1 << 40)}" for _ in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[50_000:50_060] + ["own"] + long[-70:])), (3, "a" * 3_000_000)]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:2] == (150_000, 0) and got[2] == (131, 130, "own") and got[3][:2] == (1, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(df).collect() == []


def test_digest_is_of_kept_words(spark, tmp_path):
    from siftwell.llm.queries import op1_substring_dedup

    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(1, text), (2, "new " + text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    a, b = op1_substring_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a.n_removed, b.n_removed) == (0, 60)
    assert b.kept_sha256 == hashlib.sha256(b"new").hexdigest()

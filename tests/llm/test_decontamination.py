import random

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import decontamination as module
from siftwell.llm.decontamination import Item, leaked_items, tokens, without_leaks

DOCS = "doc_id long, text string, item_id string"


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.choice("abcdefg") for _ in range(r.randint(1, 70))] for _ in range(2))
        item = Item(1, " ".join(a))
        assert item.common(tokens(pa.array([" ".join(b)]))[0].tolist())[0] == longest_common(a, b)


def test_answers():
    assert Item(1, "What is it? The answer word").answer == 3
    assert Item(1, "Question. Answer: yes indeed").answer == 2
    assert Item(1, " ".join("abcdefghij")).answer == 2
    words = tokens(pa.array(["what is the colour of the sky today blue"]))[0].tolist()
    assert Item(1, "What is the colour of the sky? blue").leaks(words)[0]


def corpus(seed=1, n=300):
    r = random.Random(seed)
    vocab = ["the", "of", "and", "to", "in"] * 60 + ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(2500)]
    text = lambda k: [r.choice(vocab) for _ in range(k)]
    items = [(i, text(r.randint(15, 59))) for i in range(30)]
    docs, leaked = [], set()
    for i in range(n):
        t = text(r.randint(0, 400))
        if i % 6 == 0:
            k, w = items[r.randint(0, 29)]
            w = list(w)
            if i % 12 == 0:  # a paraphrase: a sixth of the words are other ones
                w = [x if r.random() > 1 / 6 else r.choice(vocab) for x in w]
            at = r.randint(0, len(t))
            t = t[:at] + [x.upper() if r.random() < 0.1 else x + r.choice(["", ",", "."]) for x in w] + t[at:]
            leaked.add((i, k))
        docs.append((i, " ".join(t), "x"))
    return docs, [(i, " ".join(w)) for i, w in items], leaked


def test_leaks_are_found_and_others_left(spark):
    docs, items, leaked = corpus()
    df = spark.createDataFrame(docs + [(900, None, "x"), (901, "", "x"), (902, "of the", "x"), (None, "clean words only here", "x")], DOCS)
    bench = spark.createDataFrame(items + [(500, ""), (501, None), (502, "qqq zzz")], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in leaked_items(df, bench).collect()}
    assert len(found & leaked) >= 0.96 * len(leaked)
    assert len({d for d, _ in found} - {d for d, _ in leaked}) <= 1
    left = without_leaks(df, bench)
    assert left.columns == df.columns
    assert {x.doc_id for x in left.collect()} == {d for d, _, _ in docs} - {d for d, _ in found} | {900, 901, 902, None}


def test_every_passage_meets_every_item(spark, monkeypatch):
    """Without the cosine all pairs that the exact check accepts are found: the recall of the search against brute force."""
    docs, items, _ = corpus(7)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in leaked_items(df, bench).collect()}
    everything = {(x.doc_id, x.item_id) for x in leaked_items(df, bench, cosine=-2.0).collect()}
    assert found <= everything and len(found) >= 0.97 * len(everything)


def test_item_blocks(spark, monkeypatch):
    docs, items, _ = corpus(3, 60)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    one = {(x.doc_id, x.item_id) for x in leaked_items(df, bench).collect()}
    monkeypatch.setattr(module, "ITEMS", 8)
    assert {(x.doc_id, x.item_id) for x in leaked_items(df, bench).collect()} == one


def test_singular_values(spark):
    docs, _, _ = corpus(2, 200)
    table, singular, weights = module.latent_space(spark.createDataFrame(docs, DOCS).select("text"))
    assert np.isfinite(table).all() and (np.diff(singular) >= -1e-6).all() and len(weights) == module.BINS


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f", "x")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [120, 200, 600])
def test_long_items(spark, n):
    """Verbatim, at 0.8 of the item, and at 0.6 with its answer: what the exact check accepts is found at any length."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    vocab = [word() for _ in range(6000)]
    item = r.sample(vocab, n)
    kept = lambda share: [w if i % 10 < 10 * share or i >= 0.8 * n else r.choice(vocab) for i, w in enumerate(item)]
    text = lambda: [r.choice(vocab) for _ in range(150)]
    docs = [(i, " ".join(text()), "x") for i in range(300)]
    docs += [(900 + i, " ".join([*text(), *w, *text()]), "x") for i, w in enumerate([item, kept(0.8), kept(0.6)])]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in leaked_items(df, bench).collect()} == {900, 901, 902}


def test_small_tables(spark):
    """In under 40 blocks every token is in a twentieth of them."""
    docs = [(1, "clean words that say nothing of it at all and go on for a while", "x"), (2, "so it was: alpha beta gamma delta epsilon zeta eta, they said", "x")]
    bench = spark.createDataFrame([(7, "Alpha beta gamma delta epsilon zeta eta")], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in leaked_items(spark.createDataFrame(docs, DOCS), bench).collect()] == [(2, 7)]


def test_hot_item(spark):
    """A third of all rows is the item, so its own tokens are in over a twentieth of all blocks."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    item = [word() for _ in range(20)]
    docs = [(i, " ".join(item if i % 3 == 0 else [word() for _ in range(40)]), "x") for i in range(300)]
    docs.append((900, " ".join([word() for _ in range(70)] + item + [word() for _ in range(70)]), "x"))
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {x.doc_id for x in leaked_items(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert found == {i for i in range(0, 300, 3)} | {900}


def test_rows_of_one_id_are_judged_apart(spark):
    docs, items, leaked = corpus(5, 60)
    bad = {d for d, _ in leaked}
    rows = [(None if i < 30 else 7, t, str(i)) for i, t, _ in docs]
    df, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = {x.doc_id for x in leaked_items(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert len(found & bad) >= 0.9 * len(bad) and min(found) < 30 < max(found)
    left = without_leaks(df, bench)
    assert left.columns == df.columns
    assert {int(x.item_id) for x in left.collect()} == {i for i, _, _ in docs} - found


def test_items_with_a_null_id(spark):
    docs, items, _ = corpus(5, 60)
    df = spark.createDataFrame(docs, DOCS)
    bench, nameless = (spark.createDataFrame(x, "item_id long, text string") for x in (items, [(None, t) for _, t in items]))
    found = {x.doc_id for x in leaked_items(df, bench).collect()}
    assert {(x.doc_id, x.item_id) for x in leaked_items(df, nameless).collect()} == {(d, None) for d in found}
    assert {x.doc_id for x in without_leaks(df, nameless).collect()} == {d for d, _, _ in docs} - found


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_items_in_long_texts(spark, n):
    r = random.Random(n)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9))) for _ in range(3000)]
    text = lambda: [r.choice(vocab) for _ in range(100)]
    item = ["qqq", "rrrr", "sssss", "ttt"][:n]
    docs = [(i, " ".join(text() + (item if i % 5 == 0 else item[:1] + text()[:1] + item[1:] if n > 1 else []) + text()), "x") for i in range(200)]
    found = {x.doc_id for x in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert found == set(range(0, 200, 5))


def all_windows(words, item):
    """Whether any surroundings of any passage hold the item, every one of them tried."""
    n = item.n
    if n < module.SHORTEST:
        return item.leaks(words)[0]
    return any(item.leaks(words[max(0, at - n) : at + 4 * module.BLOCK + n])[0] for at in range(0, len(words), module.BLOCK))


def test_recall_against_all_pairs(spark):
    """Items of 2 to 2000 tokens, verbatim and paraphrased, among words as frequent as in prose: all pairs of a document and an item are tried."""
    r = random.Random(12)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    weight = [1 / (i + 3) for i in range(len(vocab))]
    text = lambda k: r.choices(vocab, weight, k=k)
    items = [(i, text(n)) for i, n in enumerate([2, 3, 5, 8, 12, 15, 20, 27, 28, 40, 48, 49, 60, 90, 130, 180, 250, 500, 2000])]

    def changed(w, kind):
        out = []
        for x in w:
            if r.random() > kind[0]:
                out.append(x if r.random() > kind[1] else r.choice(vocab))
                out += text(1) if r.random() < kind[2] else []
        return out

    docs = [(i, " ".join(text(r.randint(20, 300))), "x") for i in range(200)]
    kinds = [(0, 0, 0), (0, 0.1, 0), (0, 0.2, 0), (0.1, 0.05, 0.1), (0, 0, 0.3), (0.2, 0, 0)]
    docs += [(1000 + 10 * i + k, " ".join([*text(r.randint(0, 120)), *changed(w, kind), *text(r.randint(0, 120))]), "x") for i, w in items for k, kind in enumerate(kinds)]
    bench = [Item(i, " ".join(w)) for i, w in items]
    truth = {(d, x.item_id) for d, t, _ in docs for x in bench if all_windows(tokens(pa.array([t]))[0].tolist(), x)}
    found = {(x.doc_id, x.item_id) for x in leaked_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    verbatim = {(1000 + 10 * i, i) for i, _ in items}
    # A few common words of an item under a block's length meet by chance in any long text; that is for the cosine to part.
    sizes = {i: len(w) for i, w in items}
    planted = {(d, i) for d, i in truth if d // 10 == 100 + i}
    long = {(d, i) for d, i in truth if sizes[i] >= module.BLOCK}
    print(f"recall {len(found & long)} of {len(long)} pairs, {len(found & planted)} of {len(planted)} planted")
    assert len(long) > 60 and len(planted) > 80 and verbatim <= found
    assert len(found & long) >= 0.95 * len(long), sorted(long - found)
    assert len(found & planted) >= 0.95 * len(planted), sorted(planted - found)
    assert found <= truth, sorted(found - truth)

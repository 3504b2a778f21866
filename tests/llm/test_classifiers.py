import random

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import quality_classifier, toxicity
from siftwell.llm.quality_classifier import Discriminant, P, score_quality, vectors
from siftwell.llm.toxicity import fit, is_held_out, score, term_features, train

SCHEMA = "doc_id long, text string, score int"


def word(r):
    return "".join(r.choice("abcdefghijklm") for _ in range(r.randint(3, 8)))


def toxic_corpus(seed=1, n=900):
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        t = [word(r) for _ in range(r.randint(3, 60))]
        toxic = r.random() < 0.25
        if toxic:
            t.insert(r.randint(0, len(t)), r.choice(["Zounds!", "blimeyish", "blimeyed", "blimeyer,"]))
        rows.append((i, " ".join(t), 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(5000, None, 0), (5001, "", 0), (None, "zounds", 0), (7, rows[7][1], 0)], SCHEMA)
    model = fit(docs, spark.createDataFrame(labels + [labels[0], (None, 1)], "doc_id long, toxic int"))
    got = [(x.doc_id, x.score) for x in score(docs, model).collect()]
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for _, s in got)
    held = [(s >= toxicity.THRESHOLD) == bool(dict(labels)[i]) for i, s in got if i in dict(labels) and is_held_out(i)]
    assert len(held) > 150 and sum(held) >= 0.97 * len(held)
    assert dict(got)[5000] == dict(got)[5001] < toxicity.THRESHOLD


def test_labels_of_the_held_out_fold_are_never_learnt(spark):
    rows, labels = toxic_corpus(3, 400)
    flipped = [(i, 1 - y if is_held_out(i) else y) for i, y in labels]
    docs = spark.createDataFrame(rows, SCHEMA)
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert np.array_equal(a.hashes, b.hashes) and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_swapped_terms_change_scores_less():
    """One group is named in toxic texts only by chance of the sample; the penalty takes that weight off its name."""
    r = random.Random(5)
    texts, y = [], []
    for _ in range(600):
        t = [word(r) for _ in range(12)]
        toxic = r.random() < 0.3
        if toxic:
            t.append("blimeyish")
        if r.random() < (0.7 if toxic else 0.1):
            t.append("women")
        elif r.random() < 0.2:
            t.append("men")
        texts.append(" ".join(t))
        y.append(int(toxic))
    hashes = np.unique(np.concatenate([term_features(t) for t in ("women", "men", "blimeyish")]))
    rows = []
    for t, label in zip(texts, y, strict=True):
        _, at = toxicity._members(hashes, *toxicity.features(pa.array([t])))
        rows.append((label, at))
    gap = []
    for strength in (0.0, 50.0):
        m = train(rows, hashes, counterfactual=strength)
        s = m.score(pa.array(["women are here", "men are here", "blimeyish"]))
        gap.append(abs(s[0] - s[1]))
        assert s[2] > 0.6
    assert gap[1] < 0.5 * gap[0]


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    model = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x.score for x in score(docs, model).collect()] == [0.5]
    assert score(spark.createDataFrame([], SCHEMA), model).collect() == []


def quality_corpus(n=600):
    r, rows, labels = random.Random(2), [], []
    for i in range(n):
        t = [word(r) for _ in range(r.randint(5, 200))]
        bad = i % 4 == 0
        kind = r.randint(0, 2)
        if bad:
            t = [x.upper() + "!!" for x in t] if kind == 0 else [x + "###" for x in t] if kind == 1 else t[:3] * 30
        rows.append((i, " ".join(t), 0))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows + [(9000, None, 0), (9001, "", 0), (9002, "x" * 100000, 0), (None, "y", 0)], SCHEMA)
    got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= x.score <= 1 for x in got)
    known = dict(labels)
    held = [(x.score >= quality_classifier.THRESHOLD) == bool(known[x.doc_id]) for x in got if x.doc_id in known and x.held_out]
    assert all(x.held_out == is_held_out(x.doc_id) for x in got if x.doc_id is not None)
    assert len(held) > 100 and sum(held) >= 0.97 * len(held)


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(300, P)) * 2 + 1, 1: rng.normal(size=(500, P))}
    sums = {k: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for k, v in x.items()}
    m = Discriminant(sums, shrink=0.0, ridge=0.0)
    z = x[0][:5]
    log = {}
    for k, v in x.items():
        mean, cov = v.mean(0), np.cov(v.T, bias=True)
        d = z - mean
        log[k] = -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1])
    want = 1 / (1 + np.exp(-np.clip(log[1] - log[0] + np.log(501 / 301), -30, 30)))
    assert np.allclose(m.score(z), want)


def test_vectors_do_not_depend_on_neighbours():
    texts = ["", "Ä b\nb\n\nb", "x " * 50, None, "A1 #$ é, É."]
    whole = vectors(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], vectors(pa.array([t], pa.string()))[0]), repr(t)
    assert np.isfinite(whole).all()


@pytest.mark.parametrize("labels", [[], [(1, 1)]])
def test_quality_without_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a", 0)], SCHEMA)
    got = score_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == 1 and 0 <= got[0].score <= 1
    assert score_quality(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect() == []


def test_conflicting_labels_are_not_learnt(spark):
    rows, labels = toxic_corpus(4, 300)
    docs = spark.createDataFrame(rows, SCHEMA)
    double = labels + [(i, 1 - y) for i, y in labels[:60]] + labels[60:90]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int").repartition(n)) for x, n in ((double, 3), (labels[60:], 5)))
    assert np.array_equal(a.hashes, b.hashes) and np.array_equal(a.weights, b.weights) and a.bias == b.bias
    texts, good = quality_corpus(300)
    docs = spark.createDataFrame(texts, SCHEMA)
    double = good + [(i, 1 - y) for i, y in good[:60]]
    a, b = ({x.doc_id: x.score for x in score_quality(docs.repartition(n), spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x, n in ((double, 3), (good[60:], 5)))
    assert a == b


def test_very_long_texts_are_scored_whole(spark):
    rows, labels = toxic_corpus(1, 600)
    tail = " ".join(["plain"] * 400_000) + " blimeyish blimeyer, Zounds!"
    model = fit(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in score(spark.createDataFrame([(1, tail, 0), (2, "plain", 0)], SCHEMA), model).collect()}
    assert got[1] > toxicity.THRESHOLD > got[2]


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(1, "a b", 2, "x")], "doc_id long, text string, `a b` int, `score` string")
    model = fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = score(docs, model, carry=True).select("carry.*")
    assert got.columns == docs.columns and [tuple(x) for x in got.collect()] == [(1, "a b", 2, "x")]

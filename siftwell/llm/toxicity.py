"""Toxicity scores by a counterfactual-regularised linear classifier.

Features are a text's distinct words and word beginnings of four to six bytes, lower-cased, as 64-bit hashes.  A logistic
model is fitted on labelled texts; the loss adds ``counterfactual`` times the squared change of the score's logit between
each labelled text that names an identity group and the same text with that term swapped for its counterpart, so that a
neutral mention of any group cannot carry weight of its own.

Plan.  Labelled rows outside the held-out fold are found by a join on the id; at most ``sample_rows`` of them, by a hash of
the id, fit the model.  That bound and the bounds on features are the only ones: candidates come from a distributed count
over the sample, the ``MOST_FEATURES`` that tell the classes apart from another, the sample's sparse rows of these (indices
only) go to the driver, and the weights go out with the scoring function, which reads every whole text in Arrow batches
without a shuffle.

Defined cases: a null or empty text has no features and gets the prior's score; texts of any length are read whole; repeated
rows and ids are scored row by row, so texts that tie in their features tie in their scores; rows of ``labels`` that agree
count once, and an id with different labels is not learnt from; without labelled rows all scores are 0.5; an empty table gives
an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import id_and_text, materialize, with_carry
from .near_dedup import slabs

SAMPLE_ROWS = 24_000
MOST_CANDIDATES = 1 << 15
MOST_FEATURES = 4096
THRESHOLD = 0.3

#: Identity terms and the counterparts they are swapped for.
IDENTITY_SWAPS = (
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"), ("mother", "father"),
    ("muslim", "christian"), ("muslims", "christians"), ("jew", "catholic"), ("jews", "catholics"), ("jewish", "catholic"),
    ("black", "white"), ("african", "european"), ("asian", "american"), ("gay", "straight"), ("lesbian", "straight"),
    ("trans", "cis"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("refugee", "resident"), ("disabled", "abled"),
    ("frau", "mann"), ("frauen", "männer"), ("muslime", "christen"), ("juden", "katholiken"), ("ausländer", "inländer"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien"), ("juif", "catholique"), ("immigré", "citoyen"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano"), ("judío", "católico"), ("inmigrante", "ciudadano"),
)

_LETTER = np.zeros(256, bool)
_LETTER[128:] = _LETTER[65:91] = _LETTER[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BEGINNINGS = (4, 5, 6)


def held_out(doc_id):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def _tokens(texts: pa.Array):
    """Starts and lengths of letter runs, the text each belongs to, and the lower-cased bytes."""
    buf, off = B.concat(texts)
    end = int(off[-1])
    is_letter = np.zeros(end + 2, bool)
    is_letter[1:-1] = _LETTER[buf[:end]]
    starts = np.flatnonzero(is_letter[1:-1] & ~is_letter[:-2])
    ends = np.flatnonzero(is_letter[1:-1] & ~is_letter[2:]) + 1
    doc = np.searchsorted(off, starts, "right") - 1
    return _LOWER[buf], starts, ends - starts, doc


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of text number and feature hash, repeats included."""
    buf, starts, lens, doc = _tokens(texts)
    docs, hashes = [doc], [B.span_hash(buf, starts, lens)]
    for n in BEGINNINGS:
        long = lens > n
        docs.append(doc[long])
        hashes.append(B.span_hash(buf, starts[long], np.full(int(long.sum()), n), n))
    return np.concatenate(docs), np.concatenate(hashes)


def _distinct(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[new], item[new]


def term_features(term: str) -> np.ndarray:
    return np.unique(features(pa.array([term]))[1])


def _positive_counts(batches):
    for batch in batches:
        for part in slabs(batch):
            doc, h = _distinct(*features(part.column("text")))
            own, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(n)], names=["h", "n"])


def _members(known: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and places in the sorted hashes ``known``, each pair once."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = known[at] == h
    return _distinct(doc[hit], at[hit])


def _sparse_rows(known: np.ndarray):
    def run(batches):
        for batch in batches:
            for part in slabs(batch):
                doc, at = _members(known, *features(part.column("text")))
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [at[edge[i] : edge[i + 1]].astype(np.uint16).tobytes() for i in range(part.num_rows)]
                yield pa.record_batch([part.column("label"), pa.array(blobs, pa.binary())], names=["label", "items"])

    return run


def _class_counts(known: np.ndarray):
    """For each known feature, in how many texts it is, and in how many of label 1: one row a feature and task."""

    def run(batches):
        total = np.zeros((2, len(known) + 1), np.int64)
        for batch in batches:
            for part in slabs(batch):
                label = part.column("label").to_numpy()
                doc, at = _members(known, *features(part.column("text")))
                total[0] += np.bincount(at, minlength=len(known) + 1)
                total[1] += np.bincount(at[label[doc] == 1], minlength=len(known) + 1)
                total[:, -1] += len(label), int(label.sum())
        full = np.flatnonzero(total[0])
        yield pa.record_batch([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])], names=["at", "n", "positive"])

    return run


class Model:
    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if len(self.hashes):
            doc, at = _members(self.hashes, *features(texts))
            z += np.bincount(doc, self.weights[at], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(rows: list[tuple[int, np.ndarray]], by: int = 1000):
    """Row number, label and feature of all entries, for a thousand rows at a time: the whole would be some 100 MB an array."""
    for i in range(0, len(rows), by):
        part = rows[i : i + by]
        size = [len(r[1]) for r in part]
        yield np.repeat(np.arange(i, i + len(part)), size), np.repeat([float(r[0]) for r in part], size), np.concatenate([r[1] for r in part]).astype(np.int64)


def chosen_features(n: int, positives: int, all_: np.ndarray, pos: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the features with the largest chi-square, and of all identity terms, ``MOST_FEATURES`` at most."""
    rate = positives / max(n, 1)
    spread = np.maximum(all_ * rate * (1 - rate) * (1 - all_ / (n + 1)), 1e-9)
    chi = (pos - all_ * rate) ** 2 / spread
    held = np.isin(hashes, np.concatenate([term_features(t) for pair in IDENTITY_SWAPS for t in pair]))
    # Beyond 4.5 standard deviations no feature of a few ten thousand is there by chance.
    keep = np.flatnonzero((chi > 20) | held)
    return np.sort(keep[np.argsort(-(chi[keep] + held[keep] * 1e12), kind="stable")[:MOST_FEATURES]])


def train(rows: list[tuple[int, np.ndarray]], hashes: np.ndarray, counterfactual: float = 1.0, l2: float = 1.0, steps: int = 300) -> Model:
    """``rows``: label and sorted places in ``hashes`` of each labelled text."""
    n = len(rows)
    y = np.array([r[0] for r in rows], float)
    if not n or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2) if n else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))))
    m = len(hashes)
    pos, all_ = np.zeros(m), np.zeros(m)
    for _, label, item in _parts(rows):
        pos += np.bincount(item, label, m)
        all_ += np.bincount(item, minlength=m)
    rate = y.mean()
    keep = chosen_features(n, int(y.sum()), all_, pos, hashes)
    swaps = []
    place = {int(h): i for i, h in enumerate(hashes)}
    for a, b in IDENTITY_SWAPS:
        x, z = ([place[int(h)] for h in term_features(t) if int(h) in place] for t in (a, b))
        swaps.append((x, z))
    held = np.zeros(m, bool)
    for x, z in swaps:
        held[x] = held[z] = True
    new = np.full(m, -1)
    new[keep] = np.arange(len(keep))
    kept_rows, kept_items = [], []
    for place_, _, item in _parts(rows):
        ok = new[item] >= 0
        kept_rows.append(place_[ok])
        kept_items.append(new[item[ok]])
    row, item = np.concatenate(kept_rows), np.concatenate(kept_items)
    # The change of a text's features when a term in it is swapped, and how many texts there are of each.
    pairs = []
    has = [set() for _ in range(len(keep))] if held[keep].any() else []
    if has:
        named = held[keep][item]
        for r, i in zip(row[named].tolist(), item[named].tolist(), strict=True):
            has[i].add(r)
    for x, z in swaps:
        for mine, other in ((x, z), (z, x)):
            mine, other = [new[i] for i in mine if new[i] >= 0], [new[i] for i in other if new[i] >= 0]
            if mine and has:
                count = len(set.intersection(*(has[i] for i in mine)))
                if count:
                    d = np.zeros(len(keep))
                    d[other] += 1
                    d[mine] -= 1
                    pairs.append((count, d))
    w, b = np.zeros(len(keep)), float(np.log(rate / (1 - rate)))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[item], n) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(item, g[row], len(keep)) / n + l2 * w / n
        for count, d in pairs:
            gw += counterfactual * 2 * count / n * (d @ w) * d
        gb = g.mean()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate_t = 0.1 / (1 + t / 100)
        w -= rate_t * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b -= rate_t * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return Model(hashes[keep], w, b)


def learnt_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(doc_id, label)`` outside the held-out fold, one row an id; an id with different labels has none."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    return known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, counterfactual: float = 1.0) -> Model:
    """Fits on labelled rows outside the held-out fold, ``sample_rows`` of them at most."""
    chosen = learnt_labels(labels, id_col, label_col).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample is at most ``sample_rows`` pairs of numbers, so it goes to the texts instead of the texts to it.
    rows = materialize(id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("label", "text"), "sample")
    counts = rows.filter("label = 1").select("text").mapInArrow(_positive_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n >= 3")
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_CANDIDATES).toPandas()
    hashes = top["h"].to_numpy(np.int64).view(np.uint64)
    terms = np.concatenate([term_features(t) for pair in IDENTITY_SWAPS for t in pair])
    hashes = np.union1d(hashes, terms)
    # At most one row a candidate.
    by_class = rows.mapInArrow(_class_counts(hashes), "at long, n long, positive long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toPandas()
    all_, pos = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    all_[by_class["at"].to_numpy(np.int64)], pos[by_class["at"].to_numpy(np.int64)] = by_class["n"].to_numpy(), by_class["positive"].to_numpy()
    hashes = hashes[chosen_features(int(all_[-1]), int(pos[-1]), all_[:-1], pos[:-1], hashes)]
    got = rows.mapInArrow(_sparse_rows(hashes), "label int, items binary").toPandas()
    # In one order, so that the sums of a rerun agree to the last bit.
    return train(sorted(((int(y), np.frombuffer(x, np.uint16)) for y, x in zip(got["label"], got["items"], strict=True)), key=lambda r: (r[0], r[1].tobytes())), hashes, counterfactual)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, score`` for every row (with ``carry`` the row as a struct)."""
    rows, schema = id_and_text(docs, id_col, text_col, carry), "doc_id long, score double"

    def run(batches):
        for batch in batches:
            for part in slabs(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(model.score(part.column("text"))), *([part.column("carry")] if carry else [])], names=["doc_id", "score", *(["carry"] if carry else [])])

    return rows.mapInArrow(run, with_carry(schema, docs) if carry else schema)

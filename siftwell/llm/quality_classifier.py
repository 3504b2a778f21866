"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (lengths, shares of characters of each kind, repetition).  Each class
has a mean and a covariance, shrunk towards the pooled covariance and by a ridge; the score is the posterior of class 1:
the logistic of half the difference of Mahalanobis distances and log determinants plus the log prior odds.  Cholesky factors
are computed once and go out with the scoring function.

Plan.  One pass over all texts in Arrow batches writes the vectors; the classes' moments are sums over all labelled rows
outside the held-out fold, of whole numbers (so that no order of adding changes a score), added per task and then by Spark:
the driver gets 157 numbers for each class.  A second pass scores the vectors.

Defined cases: a null or empty text is the vector of an empty text and is scored; texts of any length are read whole; repeated
rows and ids are scored row by row, so equal texts tie; rows of ``labels`` that agree count once, and an id with different
labels is not learnt from; with fewer than two labelled rows of a class all scores are the prior; an empty table gives an
empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._common import id_and_text, materialize, with_carry
from .near_dedup import slabs
from .toxicity import held_out, learnt_labels

SHRINK = 0.1
RIDGE = 1e-3
THRESHOLD = 0.7
#: Moments are summed in units of one in so many.
UNIT = 1 << 24

NAMES = ("words", "word_length", "upper", "digit", "symbol", "mark", "other", "distinct", "same_as_last", "window_repeats", "line_repeats", "line_length")
P = len(NAMES)

_KIND = np.zeros(256, np.int8)  # 0 letters and spaces
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3
_KIND[[ord(c) for c in "!?.,;:'\"()-"]] = 4
_KIND[[ord(c) for c in "@[]\\^_`{}~+=/"]] = 5


def _runs_of_lines(buf: np.ndarray, off: np.ndarray):
    """Starts and ends of non-empty lines, and the text of each."""
    end = int(off[-1])
    brk = np.flatnonzero(buf[:end] == 10)
    starts = np.concatenate([[0], brk[:-1] + 1]) if len(brk) else np.zeros(0, np.int64)
    full = brk > starts
    starts, ends = starts[full], brk[full]
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _per_text(doc: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(doc, weights, n).astype(float)


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Items of each text that equal an earlier item of it."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    return _per_text(d[1:][(d[1:] == d[:-1]) & (x[1:] == x[:-1])], n)


def vectors(texts: pa.Array) -> np.ndarray:
    """One row of ``P`` numbers for each text."""
    n = len(texts)
    buf, off = B.concat(texts)
    end = int(off[-1])
    size = np.maximum(np.diff(off) - 1, 0).astype(float)
    kind = _KIND[buf[:end]]
    kind[1:][(buf[: end - 1] == 0xC3) & (buf[1:end] >= 0x80) & (buf[1:end] <= 0x9E)] = 1  # À to Þ
    of = np.repeat(np.arange(n), np.diff(off))
    shares = [_per_text(of[kind == k], n) / (size + 20) for k in range(1, 6)]
    starts, ends, counts = B.words(buf, off)
    doc = B.repeat_index(counts)
    h = B.span_hash(buf, starts, ends - starts)
    words = counts.astype(float)
    chars = _per_text(doc, n, ends - starts)
    same = _per_text(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], n)
    again = _repeats(doc, h, n)
    w8 = B.window_hash(h, 8)
    inside = doc[: len(w8)] == doc[7:] if len(w8) else np.zeros(0, bool)
    windows = _repeats(doc[: len(w8)][inside], w8[inside], n)
    ls, le, ld = _runs_of_lines(buf, off)
    lines = _per_text(ld, n)
    dup = _repeats(ld, B.span_hash(buf, ls, le - ls), n)
    root = lambda x: np.sqrt(np.maximum(x, 0))
    return np.stack(
        [np.log1p(words), np.log1p(chars / (words + 1)), *(root(s) for s in shares), again / (words + 20), root(same / (words + 5)), root(windows / (words + 5)), root(dup / (lines + 2)), np.log1p(words / (lines + 1))],
        1,
    )


def _vectors(carry: bool):
    def run(batches):
        for batch in batches:
            for part in slabs(batch):
                v = vectors(part.column("text"))
                v = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), P).cast(pa.list_(pa.float64()))
                yield pa.record_batch([part.column("doc_id"), v, *([part.column("carry")] if carry else [])], names=["doc_id", "v", *(["carry"] if carry else [])])

    return run


def _moments(batches):
    """For each class and place: rows, sums and sums of products of a batch, in units."""
    for b in batches:
        y = b.column("label").to_numpy()
        x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, P)
        for k in (0, 1):
            part = x[y == k]
            sums = np.concatenate([[len(part)], np.rint(part * UNIT).sum(0), np.rint(part[:, :, None] * part[:, None, :] * UNIT).sum(0).ravel()]).astype(np.int64)
            yield pa.record_batch([pa.array(np.full(len(sums), k)), pa.array(np.arange(len(sums))), pa.array(sums)], names=["label", "at", "sums"])


class Discriminant:
    """``prior``: log odds; ``mean``, ``factor`` (lower triangular), ``logdet`` by class."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float = SHRINK, ridge: float = RIDGE):
        n = {k: s[0] for k, s in sums.items()}
        self.usable = min(n.values()) >= 2
        self.prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        if not self.usable:
            return
        self.mean = {k: s[1 : 1 + P] / n[k] for k, s in sums.items()}
        cov = {k: s[1 + P :].reshape(P, P) / n[k] - np.outer(self.mean[k], self.mean[k]) for k, s in sums.items()}
        pooled = sum(cov[k] * n[k] for k in cov) / sum(n.values())
        self.factor, self.inverse, self.logdet = {}, {}, {}
        for k in cov:
            s = (1 - shrink) * cov[k] + shrink * pooled
            s += ridge * np.eye(P)
            self.factor[k] = np.linalg.cholesky(s)
            self.inverse[k] = np.linalg.inv(self.factor[k])  # of a 12 x 12 triangle, once
            self.logdet[k] = 2 * float(np.log(np.diag(self.factor[k])).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.usable:
            half = {}
            for k in (0, 1):
                y = self.inverse[k] @ (x - self.mean[k]).T
                half[k] = 0.5 * ((y * y).sum(0) + self.logdet[k])
            z += half[0] - half[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrink: float = SHRINK, carry: bool = False, extra: list[Column] | None = None) -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``docs``; with ``carry`` the columns ``extra`` of the row (all by default) as a struct."""
    rows, schema = id_and_text(docs, id_col, text_col), "doc_id long, v array<double>"
    if carry:
        held = docs.select(*(extra or [F.col(f"`{c}`") for c in docs.columns]))
        schema = with_carry(schema, held)
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(*(extra or [F.col(f"`{c}`") for c in docs.columns])).alias("carry"))
    table = materialize(rows.mapInArrow(_vectors(carry), schema), "vectors")
    known = learnt_labels(labels, id_col, label_col)
    parts = table.select("doc_id", "v").join(known, "doc_id").select("label", "v").mapInArrow(_moments, "label long, at long, sums long")
    sums = {k: np.zeros(1 + P + P * P) for k in (0, 1)}
    for k, at, total in parts.groupBy("label", "at").agg(F.sum(F.col("sums").cast("decimal(38,0)"))).collect():
        sums[k][at] = float(total) / (UNIT if at else 1)
    model = Discriminant(sums, shrink)

    def run(batches):
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, P)
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(x)), *([b.column("carry")] if carry else [])], names=["doc_id", "score", *(["carry"] if carry else [])])

    schema = with_carry("doc_id long, score double", held) if carry else "doc_id long, score double"
    return table.mapInArrow(run, schema).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", *(["carry"] if carry else []))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words.  The sources share the budget by weight; a source gets at most ``max_epochs`` times its size, and what it
can't take is shared again by weight.  A source's target is met by whole epochs of all its documents first; the rest is drawn
without replacement: each document gets the key ``-ln(u) / w`` from a hash ``u`` of its id and text and its quality weight
``w``, and the documents with the smallest keys are taken until their summed sizes reach the rest; of the last one only as many
words are taken as were missing (``taken`` says how many; its first ones, say), so a source's words meet its target to within
one.  The weight is the quality classifier's score (``mix_by_quality``) or any column of positive numbers (``mix_sources``).

Plan.  No source is ever sorted as a whole, for one may hold a third of all rows.  Keys are cut into ``bins`` by the
exponential distribution of the source's mean weight, bins are summed (partial aggregates) and prefix-summed; the bin of each
source in which the budget ends is cut into ``bins`` again in the same way, and only the one of these in which it ends, some
``1 / bins ** 2`` of the source, is ordered by row.  Sums of a source are ``bins`` rows at most.  The shares are worked out on
one row per source, so the number of sources is taken to fit one task.

Defined cases: a null text has size 0 and is taken as often as its source's epochs ask, which adds no words; texts of any
length are counted whole; a null source is a source of its own, last in order; weights repeat over sources in code point
order; ties of keys order by id, null last, then by size, by a hash of the text and by the row's place; repeated rows are
documents of their own, which share a key where they have an id, and draw keys apart by their place in the input where they
have none; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import LAST_ID, materialize
from .quality_classifier import score_quality

BINS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: list[float], max_epochs: float, budget: float = 1.0) -> DataFrame:
    """Adds ``target`` to ``(source, source_size)``: min(cap, weight * level), with one level for all.

    The level is found in closed form: sources in order of cap / weight reach their caps one after the other.
    """
    one = Window.partitionBy(F.lit(0))  # one row per source
    order = one.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = one.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(one) * F.lit(float(budget)))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("rest_weight", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    # The level if this source and all with larger ratios stay below their caps; the first of them that does sets it.
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest_weight"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(one))
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(11))


def _text(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 7,
    bins: int = BINS,
    quality: Column | None = None,
    carry: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, epochs, drawn, taken, key`` (and with ``carry`` the row as a struct).

    ``quality``: a column of positive weights over ``docs``; by default all weigh the same.
    """
    text = _text(text_col)
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        n_words(text).alias("size"),
        (quality if quality is not None else F.lit(1.0)).alias("w"),
        _content(text).alias("content"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carry")] if carry else []),
    )
    return _mixed(rows, weights, max_epochs, seed, bins, carry)


def mix_by_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: int = 7,
    bins: int = BINS,
    least_weight: float = 0.05,
    carry: bool = False,
) -> DataFrame:
    """``mix_sources`` with the score of the quality classifier, fitted on ``labels``, as weight, ``least_weight`` at least."""
    text = _text(text_col)
    extra = [F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), _content(text).alias("content")]
    if carry:
        extra.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    got = score_quality(docs, labels, id_col, text_col, carry=True, extra=extra)
    rows = got.select("doc_id", "carry.source", "carry.size", F.greatest("score", F.lit(least_weight)).alias("w"), "carry.content", *([F.col("carry.row").alias("carry")] if carry else []))
    return _mixed(rows, weights, max_epochs, seed, bins, carry)


def _edges(sums: DataFrame, bin_: str) -> DataFrame:
    """Of each source, the bin in which ``rest`` words are reached, and the words before it.

    Bins that end within the rest are taken whole; the first that passes it is split; later ones are left.
    """
    before = Window.partitionBy("source").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("bin_size").over(before), F.lit(0)) + F.col("from"))
    sums = sums.filter((F.col("start") <= F.col("rest")) & (F.col("start") + F.col("bin_size") > F.col("rest")))
    return sums.groupBy("source").agg(F.min(bin_).alias("edge"), F.min_by("start", bin_).alias("start"), F.first("rest").alias("left"))


def _mixed(rows: DataFrame, weights, max_epochs: int, seed: int, bins: int, carry: bool) -> DataFrame:
    """``rows``: ``doc_id, source, size, w, content`` and perhaps ``carry``."""
    rows = rows.withColumn("w", F.greatest("w", F.lit(1e-6))).withColumn("place", F.monotonically_increasing_id())
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("content"), F.when(F.col("doc_id").isNull(), F.col("place")))
    # u in (0, 1) from the upper 53 bits of the hash.
    u = (F.shiftrightunsigned(h, 11) + 0.5) / float(1 << 53)
    rows = materialize(rows.withColumn("key", -F.log(u) / F.col("w")), "mix")

    sources = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("w").alias("mean_w")), "sources")
    plan = water_fill(sources.select("source", "source_size"), list(weights), max_epochs).join(sources.select(F.col("source").alias("s"), "mean_w"), F.expr("source <=> s")).drop("s")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = materialize(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "plan")

    at = plan.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "mean_w")
    # Twice: where in the source's distribution the key lies, as a bin and as a bin of that bin.
    part = (1 - F.exp(-F.col("key") * F.col("mean_w"))) * bins
    placed = rows.join(at, F.expr("source <=> s")).drop("s").withColumn("bin", F.least(F.floor(part), F.lit(bins - 1)).cast("int"))
    placed = placed.withColumn("fine", F.least(F.floor((part - F.col("bin")) * bins), F.lit(bins - 1)).cast("int"))
    sums = placed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"), F.lit(0).alias("from"))
    edge = materialize(_edges(sums, "bin"), "edge")
    at = edge.select(F.col("source").alias("s"), "edge", "start")
    placed = placed.join(at, F.expr("source <=> s"), "left").drop("s")
    sums = placed.filter("bin = edge").groupBy("source", "fine").agg(F.sum("size").alias("bin_size"), F.first("rest").alias("rest"), F.first("start").alias("from"))
    fine = materialize(_edges(sums, "fine"), "edge")
    at = fine.select(F.col("source").alias("s"), F.col("edge").alias("fine_edge"), F.col("start").alias("fine_start"), "left")
    placed = placed.join(at, F.expr("source <=> s"), "left").drop("s")
    mine = F.struct("key", F.coalesce("doc_id", F.lit(LAST_ID)).alias("at"), F.col("doc_id").isNull().alias("none"), "size", "content", "place")
    split = placed.filter("bin = edge and fine = fine_edge").select("source", "size", "fine_start", "left", mine.alias("mine"))
    upto = Window.partitionBy("source").orderBy("mine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = split.withColumn("sum", F.sum("size").over(upto) + F.col("fine_start"))
    # A document is drawn if words were missing before it; the last one gives as many as were.
    split = split.withColumn("missing", F.col("left") - (F.col("sum") - F.col("size"))).filter("missing > 0")
    last = materialize(split.groupBy("source").agg(F.max("mine").alias("last"), F.max_by("missing", "mine").alias("missing")), "last")
    placed = placed.join(last.select(F.col("source").alias("s"), "last", "missing"), F.expr("source <=> s"), "left").drop("s")
    inside = F.when(F.col("fine") != F.col("fine_edge"), F.col("fine") < F.col("fine_edge")).otherwise(F.coalesce(mine <= F.col("last"), F.lit(False)))
    drawn = F.when(F.col("edge").isNull(), F.lit(False)).when(F.col("bin") != F.col("edge"), F.col("bin") < F.col("edge")).otherwise(inside)
    drawn = F.when(F.col("rest") > 0, drawn).otherwise(F.lit(False))
    partly = F.when(F.coalesce(mine == F.col("last"), F.lit(False)), F.least("size", F.ceil("missing").cast("long"))).otherwise(F.col("size"))
    out = placed.withColumn("drawn", drawn).withColumn("taken", F.col("size") * F.col("epochs") + F.when(F.col("drawn"), partly).otherwise(F.lit(0)))
    return out.select("doc_id", "source", "size", "source_size", "target", "epochs", "drawn", "taken", "key", *(["carry"] if carry else []))

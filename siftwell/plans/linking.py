"""Internal linking of a site: pages that nothing links to, and how authority flows along links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, salted_join
from ..sources.rounds import Rounds


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``page, n_in, is_orphan`` for each distinct URL of ``pages`` (``page``): other captured pages that link to it.

    ``links``: ``page, link``, distinct.  Links of a page to itself, and of pages that aren't captured, don't count.
    """
    known = pages.select("page").filter("page is not null").distinct()
    n = links.filter("page <> link").join(known, "page", "left_semi").groupBy(F.col("link").alias("page")).agg(F.count("*").alias("n_in"))
    return known.join(n, "page", "left").select("page", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("n_in").isNull().alias("is_orphan"))


def authority_scores(pages: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, most_rounds: int = 100, path: str | None = None, hot_rows: int = 100_000) -> DataFrame:
    """``page, score`` by power iteration: the share of time that a visitor who follows links at random spends on each page.

    ``pages``: ``page``; ``links``: ``page, link``, distinct.  Links to pages that aren't captured, and of a page to itself, don't
    count.  A page without links passes its score to all pages alike, so scores always sum to one.

    Each round is a written table; what it changed in all arrives with that write as an observed number, so a round is one job.
    URLs are numbered when they are first written, and the rounds join numbers.  A link's share goes through a partial sum by target before it is shuffled, and a page with very many links is split.
    """
    rounds = Rounds(pages.sparkSession, path)
    known = rounds.keep("pages", pages.select("page").filter("page is not null").distinct().withColumn("id", F.monotonically_increasing_id()))
    inner = rounds.keep("known", links.filter("page <> link").select("page", "link").join(known, "page").select(F.col("id").alias("source"), "link"))
    inner = rounds.keep("inner", salted_join(inner, known.select(F.col("page").alias("link"), F.col("id").alias("target")), "link", "inner", hot_rows).select("source", "target"))
    hot = rounds.keep("hot", hot_keys(inner, "source", hot_rows))
    out = inner.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    n = known.count()
    if not n:
        return known.select("page", F.lit(0.0).alias("score"))
    cur = rounds.keep("score=0", known.select("id").join(out, "id", "left").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.lit(1.0 / n).alias("score")))
    lost = cur.filter("n_out = 0").count() / n
    for r in range(1, most_rounds + 1):
        sent = salted_join(inner, cur.filter("n_out > 0").select(F.col("id").alias("source"), (F.col("score") / F.col("n_out")).alias("share")), "source", "inner", hot=hot)
        got = sent.groupBy(F.col("target").alias("id")).agg(F.sum("share").alias("got"))
        new = cur.join(got, "id", "left").select("id", "n_out", F.col("score").alias("old"), (F.lit((1 - damping + damping * lost) / n) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
        seen = Observation()
        moved = F.coalesce(F.sum(F.abs(F.col("score") - F.col("old"))), F.lit(0.0)).alias("moved")
        kept = F.coalesce(F.sum(F.when(F.col("n_out") == 0, F.col("score"))), F.lit(0.0)).alias("lost")
        fresh = not rounds.has(f"score={r}")
        cur = rounds.keep(f"score={r}", new.observe(seen, moved, kept).drop("old") if fresh else new.drop("old"))
        # A round that was there already is only followed; whether it was the last shows when the next one is made.
        change, lost = (seen.get["moved"], seen.get["lost"]) if fresh else (1.0, cur.filter("n_out = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0])
        if change <= tolerance:
            break
    return known.join(cur, "id").select("page", "score")

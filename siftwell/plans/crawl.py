"""Crawls over captured pages: which URLs are reached from seeds, link by link, under a budget per host; and links that are broken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority, normal_url
from ..operators.html import parsed_links
from ..operators.links import is_internal, web_links
from ..operators.skew import first_of, salted_join
from ..sources.rounds import Rounds

OK, DEAD, UNKNOWN, REDIRECTED = "ok", "dead", "unknown", "redirected"


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``page, link, internal``: the distinct web links of each captured page, normalised, not capped."""
    p = pages.select(normal_url(F.col(url)).alias("page"), F.col(html).alias("html")).filter("page is not null")
    found = F.filter(F.transform(web_links(parsed_links(F.col("page"), F.col("html"))), normal_url), lambda u: u.isNotNull())
    links = p.select("page", F.explode(F.array_distinct(found)).alias("link"))
    return links.distinct().withColumn("internal", is_internal(F.col("link"), authority(F.col("page"))))


def crawl(links: DataFrame, seeds: DataFrame, budget: int, max_depth: int, path: str | None = None) -> DataFrame:
    """``url, host, depth, found_on``: what a breadth-first crawl reaches.

    ``links`` (``page, link``, distinct) stand for what fetching a page finds; ``seeds`` has ``url``.  A host gives ``budget`` pages
    in all, the nearest first and in order of URL among equally near ones; pages beyond are neither listed nor followed.

    Each round joins the frontier with the links of its pages, keeps one row a URL, takes away what was reached before by an
    anti join, and ranks what is new per host in parts, so that one host may hold most of it.  A round is a written table below
    ``path``; called again with the same path, a crawl that was cut off goes on after its last whole round.
    """
    rounds = Rounds(links.sparkSession, path)
    links = rounds.keep("links", links.select("page", "link"))
    host = authority(F.col("url"))
    cand = seeds.select("url").filter("url is not null").distinct().select("url", host.alias("host"), F.lit(None).cast("string").alias("found_on"))
    seen = None
    for depth in range(max_depth + 1):
        name = f"round={depth}"
        if seen is not None:
            cand = cand.join(seen.select("url"), "url", "left_anti").join(seen.groupBy("host").agg(F.count("*").alias("used")), "host", "left")
        else:
            cand = cand.withColumn("used", F.lit(0).cast("long"))
        left = F.lit(budget) - F.coalesce("used", F.lit(0))
        new = first_of(cand, "host", [F.col("url")], left, budget).select("url", "host", F.lit(depth).alias("depth"), "found_on")
        new, found = rounds.counted(name, new)
        seen = new if seen is None else seen.unionByName(new)
        if not found or depth == max_depth:
            return seen
        cand = new.select(F.col("url").alias("page")).join(links, "page").groupBy(F.col("link").alias("url")).agg(F.min("page").alias("found_on")).select("url", host.alias("host"), "found_on")
    return seen


def link_states(links: DataFrame, statuses: DataFrame, path: str | None = None, hot_rows: int = 100_000) -> DataFrame:
    """``links`` with ``state``: dead, unknown, redirected or ok, by the captured status of the link's target.

    ``statuses``: ``url`` (normalised, unique), ``status_code``, ``is_fetched``, ``final_url``.  A target that was never captured is
    unknown, one that was asked for in vain or answered with an error is dead.  Links to one target may be a third of all: they
    are dealt to many tasks, and so written first, below ``path``.
    """
    links = Rounds(links.sparkSession, path).keep("links", links)
    ok = F.coalesce(F.col("is_fetched"), F.lit(False)) & F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    moved = F.coalesce(normal_url(F.col("final_url")) != F.col("url"), F.lit(False)) | F.coalesce(F.col("status_code").between(300, 399), F.lit(False))
    found = statuses.select(F.col("url").alias("link"), F.when(~ok, DEAD).when(moved, REDIRECTED).otherwise(OK).alias("state"))
    return salted_join(links, found, "link", "left", hot_rows).withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))


def link_report(states: DataFrame) -> DataFrame:
    """Per page: links, and how many of them are dead, unknown and redirected."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.groupBy("page").agg(F.count("*").alias("n_links"), n(DEAD).alias("n_dead"), n(UNKNOWN).alias("n_unknown"), n(REDIRECTED).alias("n_redirected"))


def url_hops(pages: DataFrame, canonical: bool = True) -> DataFrame:
    """``url, next``: where a URL sends its visitors (``final_url``), or else which URL it names as its canonical one.

    ``pages``: ``url, final_url, canonical_url``.  URLs are normalised; a URL that leads nowhere else has no row.
    """
    url = normal_url(F.col("url"))
    to = F.coalesce(F.nullif(normal_url(F.col("final_url")), url), *([F.nullif(normal_url(F.col("canonical_url")), url)] if canonical else []))
    return pages.select(url.alias("url"), to.alias("next")).filter("url is not null and next is not null").groupBy("url").agg(F.min("next").alias("next"))


def url_chains(hops: DataFrame, path: str | None = None, hot_rows: int = 100_000) -> DataFrame:
    """``url, representative, n_hops, in_loop`` for each URL of ``hops`` (``url`` unique, ``next``), by pointer jumping.

    The number of rounds is the logarithm of the longest chain.  While a chain that ends is unresolved, each round resolves some,
    so a round that resolves none leaves only what runs into loops: their representative is the smallest URL of the loop, their
    number of hops null.
    """
    rounds = Rounds(hops.sparkSession, path)
    cur = rounds.keep("jump=0", hops.select("url", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"), F.col("next").alias("low"), F.lit(True).alias("open")))
    count, r = None, 0
    while True:
        further = cur.select(F.col("url").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("low").alias("low2"))
        step = salted_join(cur.drop("open"), further, "to", "left", hot_rows)
        open_ = F.col("to2").isNotNull()
        r += 1
        step = step.select("url", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("low", F.coalesce("low2", "low")).alias("low"), open_.alias("open"))
        cur, now = rounds.counted(f"jump={r}", step, F.col("open"))
        if now == 0 or now == count:
            break
        count = now
    settled = cur.filter("not open").select("url", F.col("to").alias("representative"), F.col("n").alias("n_hops"), F.lit(False).alias("in_loop"))
    if not now:
        return settled
    loops, size = cur.filter("open").drop("open", "n"), 1 << r
    while size < now:
        r, size = r + 1, size * 2
        further = loops.select(F.col("url").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        loops = rounds.keep(f"jump={r}", salted_join(loops, further, "to", "inner", hot_rows).select("url", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    on_loop = loops.select(F.col("url").alias("to"), F.col("low").alias("representative"))
    in_loops = salted_join(loops.select("url", "to"), on_loop, "to", "inner", hot_rows)
    return settled.unionByName(in_loops.select("url", "representative", F.lit(None).cast("long").alias("n_hops"), F.lit(True).alias("in_loop")))

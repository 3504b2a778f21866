"""Checks that a page alone can't decide: redirects, duplicates, crawlability, broken links, orphans, and what its text is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import authority, normal_url
from ..operators.content import LEAST_WORDS, page_words
from ..operators.crawlability import crawlability
from ..operators.findings import CHECKS, FAIL, PASS
from ..operators.html import parsed
from ..operators.links import is_internal, web_links
from ..operators.structured import structured_items
from ..sources.rounds import Rounds
from .crawl import link_report, link_states, url_chains, url_hops
from .linking import orphans

#: What is decided here, by category.
DECIDED = {
    "Technical SEO": ("Redirects", "Indexability", "Crawlability", "Duplicate URLs", "Broken Links", "Structured Data", "Meta Robots", "Internal Linking"),
    "Content Quality": ("Thin Content",),
}


def parsed_site(pages: DataFrame, rounds: Rounds) -> DataFrame:
    """``page`` (normalised, one row each), what was answered, and the parse, made once for all checks and written."""
    one = pages.select(normal_url(F.col("url")).alias("page"), F.struct("status_code", "is_fetched", "final_url", "html").alias("x")).filter("page is not null").groupBy("page").agg(F.max("x").alias("x")).select("page", "x.*")
    p = one.withColumn("p", parsed(F.col("page"), F.col("html")))
    kept = p.select("page", "status_code", "is_fetched", "final_url", "p.canonical_url", "p.robots_meta", "p.json_ld", F.col("p.links").alias("raw"), F.size(page_words(F.col("html"))).alias("n_words"))
    return rounds.keep("site", kept)


def site_check_statuses(pages: DataFrame, robots: DataFrame, path: str | None = None, least_words: int = LEAST_WORDS, hot_rows: int = 100_000) -> DataFrame:
    """``page, category, seq, check, status`` for the checks in ``DECIDED`` of every captured page; null where it stays open.

    ``pages``: ``url, status_code, is_fetched, final_url, html``; ``robots``: as ``robots_of`` gives it.

    * Redirects: fails by a chain of more than one hop, or a loop.  Duplicate URLs: fails where the page stands for another URL, by
      redirect or canonical link.
    * Crawlability: what robots.txt says of the page.  Meta Robots: fails by ``noindex`` or ``none``.  Indexability: answered with
      success, crawlable, not excluded, and no duplicate.
    * Broken Links: no link of the page to a captured URL that is dead.  Internal Linking: some other page links to it.
    * Structured Data: fails by a malformed block or a missing field, open without any.  Thin Content: fewer than ``least_words``.

    What a page says is only looked at where it was answered with success.
    """
    rounds = Rounds(pages.sparkSession, path)
    at = lambda name: f"{rounds.path}/{name}"
    site = parsed_site(pages, rounds)
    ok = F.coalesce(F.col("is_fetched"), F.lit(False)) & F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    urls = F.array_distinct(F.filter(F.transform(web_links(F.col("raw")), normal_url), lambda u: u.isNotNull()))
    links = site.filter(ok).select("page", F.explode(urls).alias("link"))
    links = rounds.keep("links", links.withColumn("internal", is_internal(F.col("link"), authority(F.col("page")))))
    moved = lambda canonical, name: url_chains(url_hops(site.withColumnRenamed("page", "url"), canonical), at(name), hot_rows).select(F.col("url").alias("page"), F.struct("representative", "n_hops", "in_loop").alias(name))
    dead = link_report(link_states(links.select("page", "link"), site.withColumnRenamed("page", "url").select("url", "status_code", "is_fetched", "final_url"), at("states"), hot_rows)).select("page", "n_dead")
    allowed = crawlability(site.select("page"), robots, "page", at("robots"), hot_rows).select("page", "allowed")
    data = structured_items(site.filter(ok).select("page", "json_ld"), "page").groupBy("page").agg(F.bool_or(F.col("malformed") | (F.size("missing") > 0)).alias("bad"))
    linked = orphans(site.select("page"), links).select("page", "is_orphan")
    whole = site.select("page", ok.alias("ok"), "robots_meta", "n_words")
    for more in (moved(False, "hops"), moved(True, "chain"), dead, allowed, data, linked):
        whole = whole.join(more, "page", "left")
    excluded = F.coalesce(F.col("robots_meta").rlike(r"(?i)(^|[\s,])(noindex|none)($|[\s,])"), F.lit(False))
    alone = F.col("chain").isNull() | (F.col("chain.representative") == F.col("page"))
    seen = lambda c: F.when(F.col("ok"), c)
    holds: dict[str, Column] = {
        "Redirects": F.coalesce((F.col("hops.n_hops") <= 1) & ~F.col("hops.in_loop"), F.col("hops").isNull()),
        "Indexability": F.col("ok") & F.col("allowed") & ~excluded & alone,
        "Crawlability": F.col("allowed"),
        "Duplicate URLs": alone,
        "Broken Links": seen(F.coalesce(F.col("n_dead"), F.lit(0)) == 0),
        "Structured Data": seen(~F.col("bad")),
        "Meta Robots": seen(~excluded),
        "Internal Linking": ~F.col("is_orphan"),
        "Thin Content": seen(F.col("n_words") >= least_words),
    }
    said = lambda c: F.when(c, PASS).when(~c, FAIL)
    rows = [F.struct(F.lit(cat).alias("category"), F.lit(CHECKS[cat].index(name) + 1).alias("seq"), F.lit(name).alias("check"), said(holds[name]).alias("status")) for cat, names in DECIDED.items() for name in names]
    return whole.select("page", F.explode(F.array(*rows)).alias("c")).select("page", "c.*")

"""May a robot fetch a link, and which rule of robots.txt says so: the longest pattern that matches its path wins.

A pattern is matched from the path's start; ``*`` stands for any characters, a ``$`` at its end for the path's end.  What stands
before its first ``*`` (or the ``$``) must open the path, so rules and links are joined on that text: a link offers those of its
prefixes whose lengths occur among its host's rules, and only rules that begin like it meet it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.robots import robots_evidence
from ..functions.text import let
from ..functions.urls import authority, site_root, split_url
from ..sources.rounds import Rounds
from .skew import salted_join


def robots_patterns(robots: DataFrame) -> DataFrame:
    """``host, allow, pattern, literal`` for each rule that holds for all robots.

    ``robots``: ``url`` of the robots.txt, and ``rules``, its ``ROBOTS`` struct; of a host's files the first by URL counts.  A
    rule's comment is no part of it, and an empty rule says nothing.
    """
    host = authority(F.col("url"))
    one = robots.filter("rules is not null").groupBy(host.alias("host")).agg(F.min_by("rules", "url").alias("r"))
    rule = lambda values, allow: F.transform(values, lambda p: F.struct(F.lit(allow).alias("allow"), F.trim(F.regexp_replace(p, r"\s*#.*$", "")).alias("pattern")))
    rules = one.select("host", F.explode(F.concat(rule(F.col("r.disallow_rules"), False), rule(F.col("r.allow_rules"), True))).alias("x")).select("host", "x.*")
    slash = F.when(F.col("pattern").rlike(r"^[/*]"), F.col("pattern")).otherwise(F.concat(F.lit("/"), F.col("pattern")))
    return rules.filter("pattern <> ''").select("host", "allow", slash.alias("pattern")).distinct().withColumn("literal", F.regexp_extract("pattern", r"^((?:[^*$]|\$(?!$))*)", 1))


def matcher(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    end = pattern.endswith("$")
    body = F.when(end, F.regexp_replace(pattern, r"\$$", "")).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(body, r"([\\.\[\]{}()+?^$|])", r"\\$1"), r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(end, F.lit("$")).otherwise(F.lit("")))


def robots_path(url: Column) -> Column:
    """What patterns are matched with: path and query, a slash at least."""
    p = split_url(url)

    def joined(x: Column) -> Column:
        path = F.when(x["path"] == "", F.lit("/")).otherwise(x["path"])
        return F.concat(path, F.when(x["query"] != "", F.concat(F.lit("?"), x["query"])).otherwise(F.lit("")))

    return let(F.struct(p["path"].alias("path"), p["query"].alias("query")), joined)


def crawlability(links: DataFrame, robots: DataFrame, url: str = "link", path: str | None = None, hot_rows: int = 100_000) -> DataFrame:
    """``links`` with ``allowed`` and ``rule`` (``Allow: /x`` or ``Disallow: /x``; null where no rule matches, then it is allowed).

    The longest pattern wins, and of equally long ones the one that allows.  Each distinct URL is decided once; a host with a third
    of the links is split wherever its rules are joined.  A null URL, or one of a host without rules, is allowed.  What is joined
    more than once is written below ``path``.
    """
    rounds = Rounds(links.sparkSession, path)
    links = rounds.keep("links", links)
    rules = rounds.keep("rules", robots_patterns(robots))
    lengths = rules.groupBy("host").agg(F.sort_array(F.collect_set(F.char_length("literal"))).alias("lengths"))
    urls = links.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct().select("url", authority(F.col("url")).alias("host"), robots_path(F.col("url")).alias("path"))
    urls = rounds.keep("urls", urls)
    known = salted_join(urls, lengths, "host", "inner", hot_rows)
    offered = known.select("url", "host", "path", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    offered = offered.select("url", "path", F.struct("host", F.substring("path", F.lit(1), F.col("n")).alias("literal")).alias("at"))
    offered = rounds.keep("offered", offered)
    by_start = rules.groupBy(F.struct("host", "literal").alias("at")).agg(F.collect_list(F.struct(F.char_length("pattern").alias("n"), "allow", "pattern", matcher(F.col("pattern")).alias("regex"))).alias("rules"))
    met = salted_join(offered, by_start, "at", "inner", hot_rows).select("url", "path", F.explode("rules").alias("r"))
    hit = met.filter(F.rlike("path", F.col("r.regex"))).groupBy("url").agg(F.max(F.struct("r.n", "r.allow", "r.pattern")).alias("r"))
    said = hit.select(F.col("url").alias(url), F.col("r.allow").alias("allowed"), F.concat(F.when(F.col("r.allow"), "Allow: ").otherwise("Disallow: "), F.col("r.pattern")).alias("rule"))
    return salted_join(links, said, url, "left", hot_rows).withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def robots_of(resources: DataFrame) -> DataFrame:
    """``url, rules`` of fetched robots.txt files in the ``RESOURCE`` table."""
    r = resources.filter("kind = 'robots'")
    return r.select(F.concat(site_root(F.col("url")), F.lit("/robots.txt")).alias("url"), robots_evidence(F.col("content"), F.col("status_code"), F.col("is_success"), F.col("is_fetched")).alias("rules"))

"""robots.txt as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import after_colon, split_lines, strip

_STRINGS = "array<string>"


def _values(lines: Column, directive: str) -> Column:
    found = F.filter(lines, lambda x: F.lower(x).startswith(directive))
    return F.filter(F.transform(found, after_colon), lambda v: v != "")


def robots_lines(content: Column) -> Column:
    """Stripped lines without blanks and comments."""
    return F.filter(F.transform(split_lines(content), strip), lambda x: (x != "") & ~x.startswith("#"))


def _wildcard_lines(lines: Column) -> Column:
    """Lines that the latest user-agent line before them puts under ``*``.

    The text is cut at user-agent lines: a piece's first line is the agent, the rest are its rules.
    """
    pieces = F.split(F.array_join(lines, "\n"), r"(?im)^user-agent:")
    mine = F.filter(F.slice(pieces, 2, 1 << 30), lambda p: strip(F.substring_index(p, "\n", 1)) == "*")
    return F.flatten(F.transform(mine, lambda p: F.slice(F.split(p, "\n"), 2, 1 << 30)))


def robots_evidence(content: Column, status: Column, is_success: Column, is_fetched: Column) -> Column:
    """``ROBOTS`` struct: null if not fetched; not accessible, with no rules, if it failed or is empty."""
    lines = robots_lines(content)
    usable = F.coalesce(is_success & (content != ""), F.lit(False))
    none = F.array().cast(_STRINGS)
    rules = _wildcard_lines(lines)
    disallow = F.when(usable, _values(rules, "disallow:")).otherwise(none)
    return F.when(
        is_fetched,
        F.struct(
            usable.alias("is_accessible"),
            status.cast("int").alias("http_status"),
            disallow.alias("disallow_rules"),
            F.when(usable, _values(rules, "allow:")).otherwise(none).alias("allow_rules"),
            F.when(usable, _values(lines, "sitemap:")).otherwise(none).alias("sitemap_urls"),
            F.arrays_overlap(disallow, F.array(F.lit("/"), F.lit("/*"))).alias("blocks_root_path"),
        ),
    )


def sitemaps_to_fetch(content: Column) -> Column:
    """Absolute sitemap URLs that robots.txt names, each once, in order.

    Stricter than the evidence's list: the directive starts its line.  Laxer: the URL may stand on a later line.
    """
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"(?imdU)^sitemap:[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u.startswith("http://") | u.startswith("https://")))

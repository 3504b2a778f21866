"""Links of a page: filter, classify, cap, sort.  Native array expressions over the parse's link array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import authority

#: Targets that are no web links, and how many links of each class a page keeps.
SKIPPED_PREFIXES = ("#", "mailto:", "tel:", "javascript:")
MOST_LINKS = 200


def web_links(links: Column) -> Column:
    """Absolute http(s) targets in document order."""

    def wanted(x: Column) -> Column:
        skip = x["raw"] == ""
        for p in SKIPPED_PREFIXES:
            skip = skip | x["raw"].startswith(p)
        return ~skip & x["absolute"].rlike(r"(?i)\Ahttps?:")

    return F.transform(F.filter(links, wanted), lambda x: x["absolute"])


def is_internal(url: Column, base_authority: Column) -> Column:
    """Same authority as the base, port and all, or a subdomain of it."""
    own = authority(url)
    return (own == base_authority) | own.endswith(F.concat(F.lit("."), base_authority))


def classify(links: Column, base_url: Column) -> tuple[Column, Column]:
    """Internal and external links: distinct, the first ``MOST_LINKS`` in document order, then sorted."""
    base = authority(base_url)
    keep = lambda found: F.array_sort(F.slice(F.array_distinct(found), 1, MOST_LINKS))
    urls = web_links(links)
    return keep(F.filter(urls, lambda u: is_internal(u, base))), keep(F.filter(urls, lambda u: ~is_internal(u, base)))

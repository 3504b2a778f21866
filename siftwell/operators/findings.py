"""Findings: what an evidence row says about the documented checks, and an issue record for each that failed.

The documentation names the checks of each category and the fields of an issue; it works out one issue in full (a missing
description) and gives one number (the length a description should have).  Which fields of the evidence decide a check, and the
severity and wording of the other issues, are this module's own, after the documented meaning of the severities.  A check that
no field decides has no status, and no score is made of any: weights of single checks are nowhere given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring

#: The checks of each category, in the documented order.
CHECKS = {
    "Technical SEO": ("HTTP Status", "HTTPS", "Robots.txt", "Sitemap", "Canonical", "Redirects", "Indexability", "Crawlability", "Duplicate URLs", "Broken Links", "Structured Data", "Meta Robots", "XML Sitemap", "Internal Linking", "URL Structure"),
    "On-Page SEO": ("Title", "Meta Description", "H1", "Heading Structure", "Image ALT", "Image File Names", "Internal Links", "External Links", "Anchor Text", "URL Readability", "Keyword Usage", "Content Structure"),
    "Content Quality": ("Content Length", "Readability", "Search Intent", "Duplicate Content", "Thin Content", "Semantic Coverage", "FAQ Presence", "Freshness", "EEAT Indicators"),
    "Performance": ("Largest Contentful Paint", "Cumulative Layout Shift", "Interaction to Next Paint", "Page Size", "Image Optimization", "Caching", "Compression", "Render Blocking Resources"),
    "Accessibility": ("Missing ALT", "Labels", "ARIA", "Heading Order", "Contrast", "Keyboard Navigation", "Viewport"),
    "Security": ("HTTPS", "Mixed Content", "Security Headers", "Safe Browsing", "Certificate", "Secure Cookies"),
}
#: The length in characters that a description should have, and the fields of an issue.
DESCRIPTION_LENGTH = (150, 160)
ISSUE_FIELDS = ("issue", "severity", "business_impact", "why_it_matters", "recommendation", "estimated_effort", "priority")

PASS, FAIL = "Pass", "Fail"

#: What a failed check is reported as: ISSUE_FIELDS but the priority, which follows from the severity.
_ISSUES = {
    ("Technical SEO", "HTTP Status"): ("Homepage Not Available", "Critical", "Visitors and search engines do not get the page", "A page that is not answered cannot be indexed", "Make the homepage answer with status 200", "Depends on the cause"),
    ("Technical SEO", "HTTPS"): ("No HTTPS", "High", "Browsers warn visitors", "Search engines prefer secure pages", "Serve the site over HTTPS and redirect to it", "1–2 hours"),
    ("Technical SEO", "Robots.txt"): ("Robots.txt Blocks the Whole Site", "Critical", "The site disappears from search results", "Robots are told to fetch no page", "Remove the rule that disallows the root", "5–10 minutes"),
    ("Technical SEO", "Sitemap"): ("No Sitemap", "Medium", "New pages are found late", "Search engines learn a site's pages from its sitemap", "Publish a sitemap and name it in robots.txt", "30–60 minutes"),
    ("Technical SEO", "Canonical"): ("Missing Canonical URL", "Medium", "Rankings are split between copies of the page", "Search engines choose the URL to show themselves", "Declare the canonical URL of the page", "5–10 minutes"),
    ("On-Page SEO", "Title"): ("Missing Title", "High", "Search results show a made-up title", "The title is the heading of a search result", "Add a unique title", "5–10 minutes"),
    ("On-Page SEO", "Meta Description"): ("Missing Meta Description", "High", "Reduced click-through rate from search results", "Search engines may generate less compelling snippets", "Add a unique 150–160 character meta description", "5–10 minutes"),
    ("On-Page SEO", "H1"): ("Missing H1", "Medium", "Visitors and search engines see no main topic", "The main heading says what the page is about", "Add one main heading", "5–10 minutes"),
    ("On-Page SEO", "Image ALT"): ("Images Without ALT Attribute", "Medium", "Images are not found by search and not read to visitors", "Alternative text is all that robots know of an image", "Describe every image in its ALT attribute", "1–2 minutes an image"),
}
_LENGTH_ISSUE = ("Meta Description Length", "Low", "Snippets are cut or too short to convince", "Search results have room for a limited number of characters", "Rewrite the meta description with 150–160 characters", "5–10 minutes")


def _statuses() -> dict[tuple[str, str], Column]:
    """Whether a check holds, by evidence fields; null where they leave it open."""
    c, robots = F.col, F.col("robots_txt")
    ok = c("http_status").between(200, 299)
    seen = lambda holds: F.when(ok, holds)
    given = lambda name: seen(F.coalesce(c(name) != "", F.lit(False)))
    alt = seen(c("images_missing_alt_count") == 0)
    return {
        ("Technical SEO", "HTTP Status"): ok,
        ("Technical SEO", "HTTPS"): c("is_https"),
        ("Technical SEO", "Robots.txt"): F.when(robots["is_accessible"], ~robots["blocks_root_path"]),
        ("Technical SEO", "Sitemap"): F.when(F.size("sitemaps") > 0, F.exists("sitemaps", lambda m: m["is_accessible"])),
        ("Technical SEO", "Canonical"): given("canonical_url"),
        ("On-Page SEO", "Title"): given("page_title"),
        ("On-Page SEO", "Meta Description"): given("meta_description"),
        ("On-Page SEO", "H1"): seen(F.size("h1_tags") > 0),
        ("On-Page SEO", "Image ALT"): alt,
        ("Accessibility", "Missing ALT"): alt,
        ("Security", "HTTPS"): c("is_https"),
    }


def check_statuses(rows: DataFrame, key: str = "audit_id") -> DataFrame:
    """``key, category, seq, check, status`` for each check of the catalogue; null status: not decided by the evidence."""
    known = _statuses()
    said = lambda holds: F.when(holds, PASS).when(~holds, FAIL)
    one = lambda cat, i, name: F.struct(F.lit(cat).alias("category"), F.lit(i).alias("seq"), F.lit(name).alias("check"), said(known.get((cat, name), F.lit(None).cast("boolean"))).alias("status"))
    every = F.array(*[one(cat, i, name) for cat, names in CHECKS.items() for i, name in enumerate(names, 1)])
    return rows.select(key, F.explode(every).alias("c")).select(key, "c.*")


def _issue(category: str, check: str, said: tuple[str, ...]) -> Column:
    fields = [F.lit(x).alias(name) for name, x in zip(ISSUE_FIELDS, said)]
    return F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"), *fields, F.lit(scoring.SEVERITIES[said[1]][1]).alias("priority"))


def findings(rows: DataFrame, key: str = "audit_id") -> DataFrame:
    """One issue per failed check, ``key, category, check`` and ``ISSUE_FIELDS``; all fields come from the row, nothing is shuffled."""
    known = _statuses()
    failed = [F.when(~known[at], _issue(*at, said)) for at, said in _ISSUES.items()]
    n = F.char_length("meta_description")
    failed.append(F.when(known["On-Page SEO", "Meta Description"] & ~n.between(*DESCRIPTION_LENGTH), _issue("On-Page SEO", "Meta Description", _LENGTH_ISSUE)))
    return rows.select(key, F.explode(F.array_compact(F.array(*failed))).alias("f")).select(key, "f.*")

"""Evidence as deterministic Markdown, in native string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many second-level headings and disallow rules are listed.
LISTED_H2, LISTED_RULES = 5, 10


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _lines(*lines: str | Column) -> Column:
    """An array of lines; null ones are left out."""
    return F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines]))


def _listing(values: Column, form, most: int | None = None, more: str = "") -> Column:
    shown = F.transform(values if most is None else F.slice(values, 1, most), form)
    if most is None:
        return shown
    rest = F.when(F.size(values) > most, F.array(_line("  - ... and ", F.size(values) - most, more))).otherwise(F.array().cast("array<string>"))
    return F.concat(shown, rest)


def evidence_text(url: Column) -> Column:
    """The Markdown block of an evidence row, its fields taken by name."""
    c = F.col
    quoted = lambda x: _line('  - "', x, '"')
    given = lambda name: F.coalesce(c(name) != "", F.lit(False))
    r = c("robots_txt")
    metadata = _lines(
        "### Page Metadata",
        F.when(given("page_title"), _line('- Title: "', c("page_title"), '"')).otherwise("- Title: **Missing** — no <title> element found"),
        F.when(given("page_title"), _line("- Title Length: ", c("page_title_length"), " characters")).otherwise("- Title Length: 0 characters"),
        F.when(given("meta_description"), _line('- Meta Description: "', c("meta_description"), '"')).otherwise('- Meta Description: **Missing** — no <meta name="description"> element found'),
        F.when(given("meta_description"), _line("- Meta Description Length: ", c("meta_description_length"), " characters")).otherwise("- Meta Description Length: 0 characters"),
        F.when(given("canonical_url"), _line("- Canonical URL: ", c("canonical_url"))).otherwise("- Canonical URL: Not found in static HTML"),
        F.when(given("page_language"), _line("- Page Language: ", c("page_language"))).otherwise("- Page Language: Not declared on <html> element"),
        "",
    )
    headings = F.concat(
        _lines("### Heading Structure", _line("- H1 Tags Found: ", F.size("h1_tags"))),
        F.when(F.size("h1_tags") > 0, _listing(c("h1_tags"), quoted)).otherwise(_lines("  - **No H1 tags found**")),
        _lines(_line("- H2 Tags Found: ", F.size("h2_tags"))),
        _listing(c("h2_tags"), quoted, LISTED_H2, " more H2 tags"),
        _lines(""),
    )
    rules, named = r["disallow_rules"], r["sitemap_urls"]
    open_robots = F.concat(
        _lines(_line("- robots.txt: Accessible (HTTP ", r["http_status"], ")"), _line("- Blocks Root Path (/): ", F.when(r["blocks_root_path"], "**Yes — all robots blocked**").otherwise("No"))),
        F.when(F.size(rules) > 0, F.concat(_lines(_line("- Disallow Rules (", F.size(rules), " found):")), _listing(rules, lambda x: _line("  - Disallow: ", x), LISTED_RULES, " more rules"))).otherwise(_lines("- Disallow Rules: None (all paths accessible to robots)")),
        F.when(F.size(named) > 0, F.concat(_lines(_line("- Sitemap URLs in robots.txt (", F.size(named), "):")), _listing(named, lambda x: _line("  - ", x)))).otherwise(_lines("- Sitemap URLs in robots.txt: None declared")),
    )
    robots = (
        F.when(r.isNull(), _lines("- robots.txt: Not fetched"))
        .when(~r["is_accessible"], _lines(_line("- robots.txt: Not accessible (HTTP ", r["http_status"], ")"), "- Disallow Rules: Could not be verified in this audit."))
        .otherwise(open_robots)
    )
    sitemap = lambda m: _line("- ", m["url"], ": ", F.when(m["is_accessible"], _line("Accessible (HTTP ", m["http_status"], ", ", m["url_count"], " URLs)")).otherwise(_line("Not accessible (HTTP ", m["http_status"], ")")))
    return F.array_join(
        F.concat(
            _lines(_line("## Verified Audit Evidence for ", url), ""),
            _lines("### Homepage", _line("- Final URL: ", F.coalesce(F.when(c("final_url") != "", c("final_url")), url)), _line("- HTTP Status: ", c("http_status")), _line("- HTTPS: ", F.when(c("is_https"), "Yes").otherwise("No")), ""),
            metadata,
            headings,
            _lines("### Links", _line("- Internal Links: ", F.size("internal_links"), " unique URLs found"), _line("- External Links: ", F.size("external_links"), " unique URLs found"), ""),
            _lines("### Images", _line("- Total Images: ", F.size("images")), _line("- Images Missing ALT Attribute: ", c("images_missing_alt_count")), _line('- Images With Empty ALT (alt=""): ', c("images_empty_alt_count")), ""),
            _lines("### robots.txt"),
            robots,
            _lines("", "### Sitemaps"),
            F.when(F.size("sitemaps") > 0, F.transform("sitemaps", sitemap)).otherwise(_lines("- No sitemaps were fetched.")),
            _lines("", "### Fields That Could Not Be Verified", 'The following items CANNOT be determined from static content. For each, write: "Could not be verified in this audit."', ""),
            F.transform("unverifiable_fields", lambda x: _line("- ", x)),
        ),
        "\n",
    )


def user_message(url: Column, text: Column) -> Column:
    return _line(
        "Please generate a complete, professional SEO audit report for: ",
        url,
        "\n\nUse only the verified evidence below. Do not invent any findings that are not supported by the evidence. "
        "For every field listed under 'Fields That Could Not Be Verified', "
        'write exactly: "Could not be verified in this audit."\n\n',
        text,
    )

"""Registered queries over the driver's tables and their DuckDB equivalents.

``pages`` rows stand for successful homepage fetches.  The table lacks images, descriptions, canonical links, robots files
and sitemaps, so those operators run over texts that both sides build from ``supplier``, ``nation`` and ``region`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.robots import robots_evidence, sitemaps_to_fetch
from .functions.sitemaps import loc_count
from .functions.urls import normalize_url
from .operators import scoring
from .operators.blocks import cover_blocks, md_blocks
from .operators.evidence import evidence
from .operators.html import parsed
from .operators.skew import dealt
from .plans.audit import captured_evidence, checked_urls, host_rollup, rejected, results, with_evidence_text, with_reports
from .sources.captures import fetch_summary, further_sitemaps, planned_requests
from .sources.reports import find_report, pdf_name, pdf_url


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured_evidence(table(spark, sf_dir, "pages"))


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("page_id", F.col("audit_id").cast("long"))


# --- URLs -------------------------------------------------------------------------------------------------------------

_PAGE_URL = "regexp_replace(regexp_replace(url, '#.*$', ''), '^(https?://[^/?#]*)/(\\?|$)', '\\1\\2')"


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("u"))
    return u.select("page_id", "u.is_valid", "u.normalized_url", "u.error_code")


def url_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw inputs of every kind, built from supplier keys: which are rejected, why, and with what message."""
    kinds = ["''", "'abc'", "concat('mailto:u', s_suppkey, '@e.com')", "concat('ftp://e', s_suppkey, '.com')", "'https://'", "concat('host', s_suppkey)", "concat('a..', s_suppkey, '.com')", "concat('  Site', s_suppkey, '.COM/ ')", "concat('https://u', s_suppkey, ':pw@e.com')", "concat('e', s_suppkey, '.com:8080/p?q=1#f')"]
    raw = f"case s_suppkey % {len(kinds)} {' '.join(f'when {i} then {k}' for i, k in enumerate(kinds))} end"
    checked = checked_urls(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(raw).alias("url")))
    return rejected(checked).select("s_suppkey", "error_code", "error_message", F.col("http_error").cast("int").alias("http_error"))


_REJECTS_SQL = """
SELECT s_suppkey,
  CASE s_suppkey % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'too_short' WHEN 2 THEN 'scheme_not_allowed' WHEN 3 THEN 'scheme_not_allowed'
    WHEN 4 THEN 'no_domain' WHEN 5 THEN 'invalid_domain' WHEN 6 THEN 'invalid_domain' ELSE 'invalid_domain' END AS error_code,
  CASE s_suppkey % 10 WHEN 0 THEN 'Please enter a website URL before clicking Audit.'
    WHEN 1 THEN '''abc'' does not look like a valid website address.'
    WHEN 2 THEN 'The scheme ''mailto:'' is not supported. Please enter an http:// or https:// website address.'
    WHEN 3 THEN 'The scheme ''ftp://'' is not supported. Please enter an http:// or https:// website address.'
    WHEN 4 THEN 'The URL does not contain a valid domain name. Please check and try again.'
    WHEN 5 THEN '''host' || s_suppkey || ''' does not look like a valid domain name. Please include the full domain, e.g. www.example.com.'
    WHEN 6 THEN '''a..' || s_suppkey || '.com'' contains consecutive dots, which is not a valid domain name.'
    ELSE '''u' || s_suppkey || ''' does not look like a valid domain name. Please include the full domain, e.g. www.example.com.' END AS error_message,
  CASE WHEN s_suppkey % 10 = 0 THEN 422 ELSE 400 END AS http_error
FROM supplier WHERE s_suppkey % 10 NOT IN (7, 9)"""


# --- Pages ------------------------------------------------------------------------------------------------------------


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_pages(spark, sf_dir)).select("page_id", "page_title", "page_title_length")


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_pages(spark, sf_dir)).select("page_id", "page_language", "is_https", "http_status")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_pages(spark, sf_dir)).select("page_id", F.explode("h1_tags").alias("heading"))


def links_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_pages(spark, sf_dir)).select("page_id", F.posexplode("internal_links").alias("pos", "link"))


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _id(_pages(spark, sf_dir)).select("page_id", F.size("internal_links").cast("long").alias("n_internal"), F.size("external_links").cast("long").alias("n_external"))


_DECODED = "replace(replace(replace({}, '&quot;', '\"'), '&middot;', '·'), '&amp;', '&')"
_TITLE = "trim(" + _DECODED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)") + ")"


# --- Pages built from suppliers: images, description, canonical, second headings, external links --------------------

_SHOP = """concat('<html lang="en"><head><title> Shop ', {k}, ' </title>',
  case when {k} % 3 = 0 then concat('<meta name="Description" content=" About ', {k}, ' ">') when {k} % 3 = 1 then '<meta name="description" content="  ">' else '' end,
  case when {k} % 2 = 0 then concat('<link rel="canonical" href="/shop/', {k}, ' ">') else '' end,
  '</head><body><h1>Shop <em>', {k}, '</em></h1><h2>One</h2><h2> </h2><h2>Two</h2>',
  '<img src="/a.jpg"><img src="b.jpg" alt=""><img src="c.jpg" alt="  "><img src="data:image/png;x" alt="OK"><img src=" "><img alt="none">',
  '<a href="/about">a</a><a href="/about">a</a><a href="/about#x">a</a><a href="#top">t</a><a href="mailto:a@b.c">m</a>',
  '<a href="https://blog.shop', {k}, '.example.com/">b</a><a href="https://other', {k}, '.example.org/x">o</a><a href="//cdn.example.net/z">c</a><a href="ftp://f.example.com">f</a>',
  '<script>var x = "<a href=no>";</script><!-- <h1>no</h1> --></body></html>')"""


def shop_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homepages of suppliers, robots.txt of all, sitemaps of some; every third homepage failed."""
    s = dealt(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    k = "cast(s_suppkey as string)"
    page = _SHOP.replace("{k} %", "s_suppkey %").format(k=k)
    root = f"concat('https://shop', {k}, '.example.com')"
    robots = f"concat('User-agent: *\\nDisallow: /admin\\n', case when s_suppkey % 5 = 0 then 'Disallow: /\\n' else '' end, 'Allow: /ok\\nUser-agent: Bot\\nDisallow: /bot\\nSitemap: ', {root}, '/sitemap.xml\\nSitemap: ', {root}, '/more.xml')"
    sitemap = f"concat('<urlset><url><loc>', {root}, '/1</loc></url><url><loc >x</loc></url></urlset>')"
    row = lambda seq, kind, path, status, body: f"named_struct('seq', {seq}, 'kind', '{kind}', 'url', concat({root}, '{path}'), 'status_code', {status}, 'content', {body})"
    rows = ", ".join([row(0, "homepage", "", "case when s_suppkey % 7 = 6 then 503 else 200 end", page), row(1, "robots", "/robots.txt", "case when s_suppkey % 4 = 3 then 404 else 200 end", robots), row(2, "sitemap", "/sitemap.xml", "case when s_suppkey % 2 = 0 then 200 else 0 end", sitemap)])
    long = s.select(F.expr(f"{k}").alias("audit_id"), F.expr(f"explode(array({rows}))").alias("r")).select("audit_id", "r.*")
    return long.select("audit_id", "seq", "kind", "url", F.col("kind").alias("label"), F.col("url").alias("final_url"), "status_code", "content", (F.col("status_code").between(200, 299)).alias("is_success"), F.lit(True).alias("is_fetched"), F.lit("").alias("error_message"))


def images_alt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(shop_resources(spark, sf_dir))
    return e.select(F.col("audit_id").cast("long").alias("s_suppkey"), F.size("images").cast("long").alias("n_images"), F.col("images_missing_alt_count").cast("long").alias("n_missing"), F.col("images_empty_alt_count").cast("long").alias("n_empty"))


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(shop_resources(spark, sf_dir))
    return e.select(F.col("audit_id").cast("long").alias("s_suppkey"), "page_title", "meta_description", F.col("meta_description_length").cast("long").alias("meta_description_length"), "canonical_url", F.array_join("h2_tags", "|").alias("h2_tags"))


def link_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evidence(shop_resources(spark, sf_dir))
    return e.select(F.col("audit_id").cast("long").alias("s_suppkey"), F.array_join("internal_links", " ").alias("internal_links"), F.array_join("external_links", " ").alias("external_links"))


def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_evidence_text(evidence(shop_resources(spark, sf_dir)))
    return e.select(F.col("audit_id").cast("long").alias("s_suppkey"), "evidence_text")


def fetch_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_summary(shop_resources(spark, sf_dir)).select(F.col("audit_id").cast("long").alias("s_suppkey"), "n_resources", "n_retrieved")


def requests_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First requests of every page's site, and the further sitemaps of suppliers' robots files."""
    u = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("audit_id"), normalize_url(F.col("url"))["normalized_url"].alias("url"))
    first = planned_requests(u).select(F.concat(F.lit("page "), "audit_id").alias("audit"), F.col("seq").cast("int").alias("seq"), "kind", "url", "label")
    more = further_sitemaps(shop_resources(spark, sf_dir)).select(F.concat(F.lit("shop "), "audit_id").alias("audit"), F.col("seq").cast("int").alias("seq"), "kind", "url", "label")
    return first.unionByName(more)


_OK_HOME = "s_suppkey % 7 <> 6"

_TEXT_SQL = """
SELECT s_suppkey, concat_ws(chr(10),
  '## Verified Audit Evidence for ' || u, '', '### Homepage', '- Final URL: ' || u,
  '- HTTP Status: ' || CASE WHEN ok THEN 200 ELSE 503 END, '- HTTPS: Yes', '', '### Page Metadata',
  CASE WHEN ok THEN '- Title: "Shop ' || s_suppkey || '"' ELSE '- Title: **Missing** — no <title> element found' END,
  '- Title Length: ' || CASE WHEN ok THEN 5 + length(s_suppkey::VARCHAR) ELSE 0 END || ' characters',
  CASE WHEN ok AND s_suppkey % 3 = 0 THEN '- Meta Description: "About ' || s_suppkey || '"' ELSE '- Meta Description: **Missing** — no <meta name="description"> element found' END,
  '- Meta Description Length: ' || CASE WHEN ok AND s_suppkey % 3 = 0 THEN 6 + length(s_suppkey::VARCHAR) ELSE 0 END || ' characters',
  CASE WHEN ok AND s_suppkey % 2 = 0 THEN '- Canonical URL: /shop/' || s_suppkey ELSE '- Canonical URL: Not found in static HTML' END,
  CASE WHEN ok THEN '- Page Language: en' ELSE '- Page Language: Not declared on <html> element' END, '', '### Heading Structure',
  CASE WHEN ok THEN '- H1 Tags Found: 1' || chr(10) || '  - "Shop ' || s_suppkey || '"' || chr(10) || '- H2 Tags Found: 2' || chr(10) || '  - "One"' || chr(10) || '  - "Two"'
       ELSE '- H1 Tags Found: 0' || chr(10) || '  - **No H1 tags found**' || chr(10) || '- H2 Tags Found: 0' END, '', '### Links',
  '- Internal Links: ' || CASE WHEN ok THEN 3 ELSE 0 END || ' unique URLs found', '- External Links: ' || CASE WHEN ok THEN 2 ELSE 0 END || ' unique URLs found', '', '### Images',
  '- Total Images: ' || CASE WHEN ok THEN 4 ELSE 0 END, '- Images Missing ALT Attribute: ' || CASE WHEN ok THEN 1 ELSE 0 END, '- Images With Empty ALT (alt=""): ' || CASE WHEN ok THEN 2 ELSE 0 END, '', '### robots.txt',
  CASE WHEN s_suppkey % 4 = 3 THEN '- robots.txt: Not accessible (HTTP 404)' || chr(10) || '- Disallow Rules: Could not be verified in this audit.'
       ELSE '- robots.txt: Accessible (HTTP 200)' || chr(10) || '- Blocks Root Path (/): ' || CASE WHEN s_suppkey % 5 = 0 THEN '**Yes — all robots blocked**' ELSE 'No' END || chr(10)
         || CASE WHEN s_suppkey % 5 = 0 THEN '- Disallow Rules (2 found):' || chr(10) || '  - Disallow: /admin' || chr(10) || '  - Disallow: /' ELSE '- Disallow Rules (1 found):' || chr(10) || '  - Disallow: /admin' END || chr(10)
         || '- Sitemap URLs in robots.txt (2):' || chr(10) || '  - ' || u || '/sitemap.xml' || chr(10) || '  - ' || u || '/more.xml' END, '', '### Sitemaps',
  '- ' || u || '/sitemap.xml: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Accessible (HTTP 200, 2 URLs)' ELSE 'Not accessible (HTTP 0)' END, '', '### Fields That Could Not Be Verified',
  'The following items CANNOT be determined from static content. For each, write: "Could not be verified in this audit."', '',
  '- Core Web Vitals (LCP, INP, CLS) — requires Lighthouse or PageSpeed Insights API',
  '- Mobile-friendliness score — requires browser rendering',
  '- Page speed / TTFB — requires a live performance test',
  '- Structured data / JSON-LD schema — may be injected by JavaScript and is invisible in static HTML',
  '- Google Search Console data — requires API access',
  '- Keyword rankings — requires a rank-tracking tool',
  '- Backlinks — requires a link index database (Ahrefs, Semrush, etc.)',
  '- Competitor analysis — requires external data sources',
  '- Full broken-link crawl — only the homepage links are visible in this audit',
  '- HTTP response headers (HSTS, X-Robots-Tag, Cache-Control) — not accessible via static fetch',
  '- Hreflang implementation — requires crawling multiple locale pages') AS evidence_text
FROM (SELECT s_suppkey, 'https://shop' || s_suppkey || '.example.com' AS u, s_suppkey % 7 <> 6 AS ok FROM supplier)"""


# --- robots.txt and sitemaps built from nations and regions ----------------------------------------------------------

_ROBOTS = r"""concat(case when n_nationkey % 2 = 0 then 'User-agent: *' else concat('USER-AGENT: bot', {k}) end, '\r\n# note\n  Disallow: /', n_name, '\n',
  case when n_nationkey % 3 = 0 then 'Disallow: /*\n' else '' end, 'disallow:\nAllow: /pub/', {k}, ' # c\n',
  case when n_nationkey % 5 = 0 then 'User-agent: *\nUser-agent: Other\nDisallow: /x\n' else '' end,
  'Sitemap: https://n', {k}, '.example.com/s.xml\nSitemap: /rel.xml\n  Sitemap: https://n', {k}, '.example.com/in.xml\nSitemap: https://n', {k}, '.example.com/s.xml')"""


def _nation_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(_ROBOTS.format(k="cast(n_nationkey as string)"))
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name", text.alias("content"))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _nation_robots(spark, sf_dir).select("n_nationkey", robots_evidence(F.col("content"), F.lit(200), F.lit(True), F.lit(True)).alias("r"))
    return r.select("n_nationkey", F.array_join("r.disallow_rules", "|").alias("disallow_rules"), F.array_join("r.allow_rules", "|").alias("allow_rules"), F.array_join("r.sitemap_urls", "|").alias("sitemap_urls"))


def robots_blocks_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched, ok = F.col("n_nationkey") % 7 != 6, F.col("n_nationkey") % 7 != 5
    r = _nation_robots(spark, sf_dir).select("n_nationkey", robots_evidence(F.col("content"), F.when(ok, 200).otherwise(404), ok, fetched).alias("r"))
    return r.select("n_nationkey", F.col("r").isNotNull().alias("is_fetched"), "r.is_accessible", F.coalesce("r.http_status", F.lit(-1)).alias("http_status"), "r.blocks_root_path")


def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_robots(spark, sf_dir).select("n_nationkey", F.array_join(sitemaps_to_fetch(F.col("content")), "|").alias("to_fetch"))


def sitemap_loc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap per region, with an entry per nation, one in a comment and a prefixed one."""
    entry = F.concat(F.lit("<url><loc>https://e.com/"), "n_name", F.lit("</loc><image:loc>x</image:loc></url>"))
    xml = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<urlset><!-- <loc>no</loc> -->"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</urlset>")).alias("content"))
    return xml.select("n_regionkey", loc_count(F.col("content")).cast("long").alias("url_count"))


# --- Reports ---------------------------------------------------------------------------------------------------------


def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of one audit, by its id, among all pages."""
    reports = table(spark, sf_dir, "pages").select(F.sha2(F.concat_ws("|", normalize_url(F.col("url"))["normalized_url"], F.lit("s1")), 256).alias("audit_id"), F.col("url"), F.concat(F.lit("# Report "), F.col("page_id").cast("string")).alias("markdown_report"))
    chosen = reports.agg(F.min("audit_id")).first()[0]
    return find_report(reports, chosen).select("audit_id", "url", "markdown_report", "pdf_download_url", pdf_name(F.col("audit_id")).alias("pdf_name"))


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template reports of all pages, as lengths and hashes of their text."""
    r = with_reports(with_evidence_text(_pages(spark, sf_dir)).select("base_url", "evidence_text"))
    return r.select("url", F.md5("markdown_report").alias("report_md5"), F.char_length("markdown_report").cast("long").alias("n_chars"))


def report_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_reports(with_evidence_text(_pages(spark, sf_dir)).select("base_url", "evidence_text"))
    return md_blocks(r, "url").select("url", "seq", "kind", "level", "text", F.array_join("items", "\n").alias("items"))


def report_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    b = o.select("o_orderkey", F.explode(cover_blocks(F.concat(F.lit("https://e.com/?a=1&b=<"), F.col("o_custkey").cast("string"), F.lit(">")), F.col("o_orderdate"))).alias("b"))
    return b.select("o_orderkey", "b.seq", "b.kind", "b.text")


def md_blocks_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("audit_id"), F.col("text").alias("markdown_report"))
    return md_blocks(c).select("audit_id", "seq", "kind", "level", "text", F.array_join("items", "\n").alias("items"))


# --- Scoring and rollups ---------------------------------------------------------------------------------------------


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores made from part sizes, weighted by category, with band, colour and grade."""
    names = list(scoring.CATEGORY_WEIGHTS)
    category = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("i") + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    p = p.select("p_partkey", category.alias("category"), ((F.col("p_size") * 7 + F.col("i") * 13 + F.col("p_partkey")) % 101).cast("double").alias("score"))
    s = scoring.overall_score(p, "p_partkey", "category", "score")
    o = F.col("overall_score")
    return s.select("p_partkey", F.round(o, 6).alias("overall_score"), scoring.status_band(F.round(o, 6)).alias("band"), scoring.band_colour(F.round(o, 6)).alias("colour"), scoring.grade(F.round(o, 6)).alias("grade"))


def severity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as severities: multiplier, priority, deadline, and counts per customer."""
    s = "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' when '4-NOT SPECIFIED' then 'Low' else 'Information' end"
    o = table(spark, sf_dir, "orders").select("o_custkey", F.expr(s).alias("severity"))
    per = scoring.severity_counts(o, "o_custkey")
    worst = o.groupBy("o_custkey").agg(F.min(scoring.priority(F.col("severity"))).alias("first_priority"), F.round(F.sum(scoring.severity_multiplier(F.col("severity"))), 6).alias("deduction"))
    return per.join(worst, "o_custkey")


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' when '4-NOT SPECIFIED' then 'Low' else 'Information' end"
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(s).alias("severity"))
    return scoring.top_findings(o, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "severity", scoring.deadline(F.col("severity")).alias("deadline"), F.col("rank").cast("long").alias("rank"))


def api_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of all suppliers' audits with a provider that has no answer for every fifth."""

    def provider(system: str, message: str, text: str) -> str:
        key = int(text.split("https://shop", 1)[1].split(".", 1)[0])
        return "" if key % 5 == 0 else f"# Report {key}"

    e = with_evidence_text(evidence(shop_resources(spark, sf_dir))).select("base_url", "evidence_text")
    r = with_reports(e, provider=provider).withColumn("pdf_download_url", pdf_url(F.col("audit_id"), F.lit(True)))
    return results(r).select("audit_id", "url", F.col("http_status").cast("int").alias("http_status"), "markdown_report", "pdf_download_url", "detail")


def host_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rollup(_pages(spark, sf_dir))


def meta_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional fields of the parse over supplier pages: Open Graph tags and robots directives."""
    html = F.concat(F.lit('<meta property="og:title" content=" T'), F.col("s_suppkey").cast("string"), F.lit(' "><meta name="ROBOTS" content="noindex">'))
    p = table(spark, sf_dir, "supplier").select("s_suppkey", parsed(F.lit("https://e.com"), html).alias("p"))
    return p.select("s_suppkey", F.element_at("p.og_tags", "og:title").alias("og_title"), F.col("p.robots_meta").alias("robots_meta"))


def pdf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(F.col("s_name")).alias("id"))
    return s.select("s_suppkey", pdf_url(F.col("id"), F.col("s_suppkey") % 3 != 0).alias("pdf_download_url"), pdf_name(F.col("id")).alias("pdf_name"))


_INTERNAL = "'https://blog.shop' || s_suppkey || '.example.com/ https://shop' || s_suppkey || '.example.com/about https://shop' || s_suppkey || '.example.com/about#x'"
_LINKS_SQL = f"""SELECT page_id, {_PAGE_URL} AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages"""
_ABSOLUTE = "list_sort(list_distinct(list_transform(hrefs, lambda h: regexp_extract(base, '^https?://[^/?#]*') || replace(h, '&amp;', '&'))))"

#: The template report of a page: what it shares with ``_TEXT_SQL`` is taken from there.
_REPORT_SQL = f"""WITH p AS ({_LINKS_SQL}), e AS (SELECT page_id, base, {_TITLE.replace("html", "h.html")} AS t, regexp_extract(h.html, '<html lang="([^"]*)"', 1) AS lang, trim({_DECODED.format("regexp_extract(h.html, '(?s)<h1>(.*?)</h1>', 1)")}) AS h1, len({_ABSOLUTE}) AS n
    FROM p JOIN pages h USING (page_id)), m AS (SELECT base, concat_ws(chr(10), '# SEO Audit Report', '', '**Website:** ' || base, '', '---', '', '### Homepage', '- Final URL: ' || base, '- HTTP Status: 200',
  '- HTTPS: ' || CASE WHEN starts_with(base, 'https://') THEN 'Yes' ELSE 'No' END, '', '### Page Metadata', '- Title: "' || t || '"', '- Title Length: ' || length(t) || ' characters',
  '- Meta Description: **Missing** — no <meta name="description"> element found', '- Meta Description Length: 0 characters', '- Canonical URL: Not found in static HTML', '- Page Language: ' || lang, '',
  '### Heading Structure', '- H1 Tags Found: 1', '  - "' || h1 || '"', '- H2 Tags Found: 0', '', '### Links', '- Internal Links: ' || n || ' unique URLs found', '- External Links: 0 unique URLs found', '',
  '### Images', '- Total Images: 0', '- Images Missing ALT Attribute: 0', '- Images With Empty ALT (alt=""): 0', '', '### robots.txt', '- robots.txt: Not fetched', '', '### Sitemaps', '- No sitemaps were fetched.', '',
  {_TEXT_SQL[_TEXT_SQL.index("'### Fields That") : _TEXT_SQL.index(") AS evidence_text")]}) || chr(10) AS text FROM e)
SELECT base AS url, md5(text) AS report_md5, length(text)::BIGINT AS n_chars FROM m"""

#: The same report's blocks: texts between three stars are bold, all else in a title stands as it is.
_INLINE_SQL = "regexp_replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\*{{3}}(.+?)\\*(.*?)\\*\\*', '<b>\\1\\2</b>', 'g')"
_UNSEEN_SQL = _TEXT_SQL[_TEXT_SQL.index("'- Core Web") : _TEXT_SQL.index(") AS evidence_text")].replace("'- ", "'")
_BLOCKS_SQL = f"""WITH {_REPORT_SQL[5 : _REPORT_SQL.index(", m AS (")]}, r AS (SELECT base, t, n, lang, replace(base, '&', '&amp;') AS u, {_INLINE_SQL.format("t")} AS bt, {_INLINE_SQL.format("h1")} AS bh FROM e),
b AS (SELECT base, unnest([
  ['heading', '1', 'SEO Audit Report', ''], ['body', '0', '<b>Website:</b> ' || u, ''], ['spacer', '0', '', ''], ['rule', '0', '', ''], ['spacer', '0', '', ''],
  ['heading', '3', 'Homepage', ''], ['bullets', '0', '', concat_ws(chr(10), 'Final URL: ' || u, 'HTTP Status: 200', 'HTTPS: ' || CASE WHEN starts_with(base, 'https://') THEN 'Yes' ELSE 'No' END)],
  ['heading', '3', 'Page Metadata', ''], ['bullets', '0', '', concat_ws(chr(10), 'Title: "' || bt || '"', 'Title Length: ' || length(t) || ' characters', 'Meta Description: <b>Missing</b> — no &lt;meta name="description"&gt; element found',
    'Meta Description Length: 0 characters', 'Canonical URL: Not found in static HTML', 'Page Language: ' || lang)],
  ['heading', '3', 'Heading Structure', ''], ['bullets', '0', '', concat_ws(chr(10), 'H1 Tags Found: 1', '"' || bh || '"', 'H2 Tags Found: 0')],
  ['heading', '3', 'Links', ''], ['bullets', '0', '', concat_ws(chr(10), 'Internal Links: ' || n || ' unique URLs found', 'External Links: 0 unique URLs found')],
  ['heading', '3', 'Images', ''], ['bullets', '0', '', concat_ws(chr(10), 'Total Images: 0', 'Images Missing ALT Attribute: 0', 'Images With Empty ALT (alt=""): 0')],
  ['heading', '3', 'robots.txt', ''], ['bullets', '0', '', 'robots.txt: Not fetched'], ['heading', '3', 'Sitemaps', ''], ['bullets', '0', '', 'No sitemaps were fetched.'],
  ['heading', '3', 'Fields That Could Not Be Verified', ''], ['body', '0', 'The following items CANNOT be determined from static content. For each, write: "Could not be verified in this audit."', ''],
  ['bullets', '0', '', concat_ws(chr(10), {_UNSEEN_SQL})]]) AS b, unnest(range(22)) AS seq FROM r)
SELECT base AS url, seq::INTEGER AS seq, b[1] AS kind, b[2]::INTEGER AS level, b[3] AS text, b[4] AS items FROM b"""

QUERIES = {f.__name__: f for f in (
    url_normalize, url_rejects, page_title, page_language, headings, links_exploded, link_counts, images_alt_counts, page_metadata, link_classes, evidence_text, fetch_summaries,
    requests_planned, robots_rules, robots_blocks_root, robots_sitemaps, sitemap_loc_count, report_lookup, report_markdown, report_blocks, report_cover, md_blocks_of_conversations, category_scores,
    severity_table, top_findings, api_results, host_summary, meta_tags, pdf_links,
)}

ORACLES = {
    "url_normalize": f"SELECT page_id, true AS is_valid, {_PAGE_URL} AS normalized_url, '' AS error_code FROM pages",
    "url_rejects": _REJECTS_SQL,
    "page_title": f"SELECT page_id, nullif(t, '') AS page_title, length(t)::INTEGER AS page_title_length FROM (SELECT page_id, {_TITLE} AS t FROM pages)",
    "page_language": "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS page_language, starts_with(url, 'https://') AS is_https, 200::INTEGER AS http_status FROM pages",
    "headings": "SELECT page_id, trim(" + _DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)") + ") AS heading FROM pages",
    "links_exploded": f"SELECT page_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS link FROM (SELECT page_id, {_ABSOLUTE} AS l FROM ({_LINKS_SQL}))",
    "link_counts": f"SELECT page_id, len({_ABSOLUTE})::BIGINT AS n_internal, 0::BIGINT AS n_external FROM ({_LINKS_SQL})",
    "images_alt_counts": f"SELECT s_suppkey, CASE WHEN {_OK_HOME} THEN 4 ELSE 0 END::BIGINT AS n_images, CASE WHEN {_OK_HOME} THEN 1 ELSE 0 END::BIGINT AS n_missing, CASE WHEN {_OK_HOME} THEN 2 ELSE 0 END::BIGINT AS n_empty FROM supplier",
    "page_metadata": f"""SELECT s_suppkey, CASE WHEN {_OK_HOME} THEN 'Shop ' || s_suppkey END AS page_title, CASE WHEN {_OK_HOME} AND s_suppkey % 3 = 0 THEN 'About ' || s_suppkey END AS meta_description,
      CASE WHEN {_OK_HOME} AND s_suppkey % 3 = 0 THEN length('About ' || s_suppkey) ELSE 0 END::BIGINT AS meta_description_length, CASE WHEN {_OK_HOME} AND s_suppkey % 2 = 0 THEN '/shop/' || s_suppkey END AS canonical_url,
      CASE WHEN {_OK_HOME} THEN 'One|Two' ELSE '' END AS h2_tags FROM supplier""",
    "link_classes": f"SELECT s_suppkey, CASE WHEN {_OK_HOME} THEN {_INTERNAL} ELSE '' END AS internal_links, CASE WHEN {_OK_HOME} THEN 'https://cdn.example.net/z https://other' || s_suppkey || '.example.org/x' ELSE '' END AS external_links FROM supplier",
    "evidence_text": _TEXT_SQL,
    "fetch_summaries": "SELECT s_suppkey, 3::BIGINT AS n_resources, ((s_suppkey % 7 <> 6)::INT + (s_suppkey % 4 <> 3)::INT + (s_suppkey % 2 = 0)::INT)::BIGINT AS n_retrieved FROM supplier",
    "requests_planned": f"""WITH u AS (SELECT page_id, {_PAGE_URL} AS url FROM pages), r AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*') AS root FROM u)
      SELECT 'page ' || page_id AS audit, 0::INTEGER AS seq, 'homepage' AS kind, url, 'homepage' AS label FROM r
      UNION ALL SELECT 'page ' || page_id, 1, 'robots', root || '/robots.txt', 'robots.txt' FROM r
      UNION ALL SELECT 'page ' || page_id, 2, 'sitemap', root || '/sitemap.xml', 'sitemap.xml' FROM r
      UNION ALL SELECT 'shop ' || s_suppkey, 3, 'extra', 'https://shop' || s_suppkey || '.example.com/more.xml', 'sitemap:https://shop' || s_suppkey || '.example.com/more.xml' FROM supplier WHERE s_suppkey % 4 <> 3""",
    "robots_rules": """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '|/*' ELSE '' END ELSE '' END AS disallow_rules,
      CASE WHEN n_nationkey % 2 = 0 THEN '/pub/' || n_nationkey || ' # c' ELSE '' END AS allow_rules,
      'https://n' || n_nationkey || '.example.com/s.xml|/rel.xml|https://n' || n_nationkey || '.example.com/in.xml|https://n' || n_nationkey || '.example.com/s.xml' AS sitemap_urls FROM nation""",
    "robots_blocks_root": """SELECT n_nationkey, n_nationkey % 7 <> 6 AS is_fetched, CASE WHEN n_nationkey % 7 <> 6 THEN n_nationkey % 7 <> 5 END AS is_accessible, CASE WHEN n_nationkey % 7 = 5 THEN 404 WHEN n_nationkey % 7 <> 6 THEN 200 ELSE -1 END::INTEGER AS http_status,
      CASE WHEN n_nationkey % 7 = 5 THEN false WHEN n_nationkey % 7 <> 6 THEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 END AS blocks_root_path FROM nation""",
    "robots_sitemaps": "SELECT n_nationkey, 'https://n' || n_nationkey || '.example.com/s.xml' AS to_fetch FROM nation",
    "sitemap_loc_count": "SELECT n_regionkey, count(*)::BIGINT AS url_count FROM nation GROUP BY n_regionkey",
    "report_markdown": _REPORT_SQL,
    "report_blocks": _BLOCKS_SQL,
    "md_blocks_of_conversations": "SELECT conv_id || '-' || turn AS audit_id, 0::INTEGER AS seq, 'body' AS kind, 0::INTEGER AS level, replace(text, chr(10), '<br/>' || chr(10)) AS text, '' AS items FROM conversations",
    "report_lookup": f"""SELECT audit_id, url, '# Report ' || page_id AS markdown_report, '/api/v1/audits/' || audit_id || '/pdf' AS pdf_download_url, 'seo-audit-' || substr(audit_id, 1, 8) || '.pdf' AS pdf_name
      FROM (SELECT sha256({_PAGE_URL} || '|s1') AS audit_id, url, page_id FROM pages) WHERE audit_id = (SELECT min(sha256({_PAGE_URL} || '|s1')) FROM pages)""",
    "report_cover": """SELECT o_orderkey, 0::INTEGER AS seq, 'title' AS kind, 'SEO Audit Report' AS text FROM orders
      UNION ALL SELECT o_orderkey, 1, 'cover_url', 'https://e.com/?a=1&amp;b=&lt;' || o_custkey || '&gt;' FROM orders
      UNION ALL SELECT o_orderkey, 2, 'cover_date', 'Generated: ' || strftime(o_orderdate, '%d %B %Y at %H:%M UTC') FROM orders
      UNION ALL SELECT o_orderkey, 3, 'rule', '' FROM orders""",
    "category_scores": """WITH c AS (SELECT * FROM (VALUES (0, 40.0), (1, 25.0), (2, 15.0), (3, 10.0), (4, 5.0), (5, 5.0)) t(i, w)),
      s AS (SELECT p_partkey, round((sum(((p_size * 7 + i * 13 + p_partkey) % 101)::DOUBLE * w::DOUBLE) / 100)::DOUBLE, 6) AS overall_score FROM part, c GROUP BY p_partkey)
      SELECT p_partkey, overall_score,
        CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 80 THEN 'Good' WHEN overall_score >= 70 THEN 'Needs Improvement' WHEN overall_score >= 60 THEN 'Poor' ELSE 'Critical' END AS band,
        CASE WHEN overall_score >= 90 THEN 'Green' WHEN overall_score >= 80 THEN 'Light Green' WHEN overall_score >= 70 THEN 'Yellow' WHEN overall_score >= 60 THEN 'Orange' ELSE 'Red' END AS colour,
        CASE WHEN overall_score >= 95 THEN 'A+' WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM s""",
    "severity_table": """WITH o AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS p FROM orders)
      SELECT o_custkey, count(*) FILTER (p = 1) AS n_critical, count(*) FILTER (p = 2) AS n_high, count(*) FILTER (p = 3) AS n_medium, count(*) FILTER (p = 4) AS n_low, count(*) FILTER (p = 5) AS n_information,
        min(p)::INTEGER AS first_priority, round(sum(CASE p WHEN 1 THEN 1.0 WHEN 2 THEN 0.75 WHEN 3 THEN 0.4 WHEN 4 THEN 0.15 ELSE 0.0 END::DOUBLE), 6) AS deduction FROM o GROUP BY o_custkey""",
    "top_findings": """WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 5 END AS p FROM orders),
      r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS rank FROM o)
      SELECT o_custkey, o_orderkey, ['Critical', 'High', 'Medium', 'Low', 'Information'][p] AS severity, ['Fix Immediately', 'Fix This Week', 'Fix This Month', 'Future Optimisation', 'Monitor Only'][p] AS deadline, rank FROM r WHERE rank <= 5""",
    "api_results": """SELECT sha256('https://shop' || s_suppkey || '.example.com|') AS audit_id, 'https://shop' || s_suppkey || '.example.com' AS url, CASE WHEN s_suppkey % 5 = 0 THEN 502 ELSE 202 END::INTEGER AS http_status,
      CASE WHEN s_suppkey % 5 <> 0 THEN '# Report ' || s_suppkey END AS markdown_report,
      CASE WHEN s_suppkey % 5 <> 0 THEN '/api/v1/audits/' || sha256('https://shop' || s_suppkey || '.example.com|') || '/pdf' ELSE '' END AS pdf_download_url,
      CASE WHEN s_suppkey % 5 = 0 THEN 'the provider returned no text' END AS detail FROM supplier""",
    "host_summary": f"""SELECT regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS host, count(*) AS n_pages, 0::BIGINT AS n_no_title, count(*) AS n_no_description, count(*) AS n_no_canonical, 0::BIGINT AS n_no_h1,
      sum(n)::BIGINT AS n_internal_links, 0::BIGINT AS n_images_missing_alt FROM (SELECT url, page_id, len({_ABSOLUTE}) AS n FROM (SELECT page_id, url, base, hrefs FROM (SELECT *, {_PAGE_URL} AS base, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages))) GROUP BY 1""",
    "meta_tags": "SELECT s_suppkey, 'T' || s_suppkey AS og_title, 'noindex' AS robots_meta FROM supplier",
    "pdf_links": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN '/api/v1/audits/' || md5(s_name) || '/pdf' ELSE '' END AS pdf_download_url, 'seo-audit-' || substr(md5(s_name), 1, 8) || '.pdf' AS pdf_name FROM supplier",
}

"""Registered queries over whole sites and several runs, and their SQL.

The site is made of ``part`` rows, one captured page each, a third of them on one host: page k links to 2k + 1, 2k + 2 and k / 2, to
paths of its own host that were never captured, and nowhere; some pages are gone, moved, or name another as canonical.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import _FINDINGS_SQL, _answers, _key_lines
from .config import Settings
from .functions.urls import normal_url
from .operators.content import content_by_host
from .operators.crawlability import crawlability, robots_of
from .operators.evidence import UNVERIFIABLE_FIELDS, evidence
from .operators.findings import _ISSUES, _LENGTH_ISSUE, CHECKS, findings
from .operators.html import parsed
from .operators.scoring import SEVERITIES
from .operators.sections import SECTIONS, report_sections
from .operators.skew import dealt
from .operators.structured import json_ld, structured_items
from .plans.action_plan import action_plan
from .plans.audit import audit_sites, captured_evidence
from .plans.counters import RunCounters
from .plans.crawl import crawl, link_report, link_states, page_links, url_chains, url_hops
from .plans.history import audit_before, changes
from .plans.linking import authority_scores, orphans
from .plans.site_checks import site_check_statuses
from .queries import _DECODED, _TITLE, shop_resources, table
from .sources.rounds import shared_folder

# --- Several runs -----------------------------------------------------------------------------------------------------

_RAW = "case {k} % 8 when 0 then '' when 1 then 'abc' when 2 then 'ftp://e.com' when 3 then 'https://' when 4 then 'a..b.com' else {s} end"


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run of the audit chain over suppliers counted while it wrote."""
    requests = table(spark, sf_dir, "supplier").select(F.expr(_RAW.format(k="s_suppkey", s="concat('s', s_suppkey, '.example.com')")).alias("url"))
    counters = RunCounters()
    audit_sites(requests, shared_folder(spark), Settings(llm_api_key="none"), _answers, provider=_key_lines, counters=counters)
    return counters.table(spark)


_COUNTERS_SQL = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 8 AS c, s_suppkey % 8 > 4 AS ok, s_suppkey % 6 > 0 AS home, s_suppkey % 6 > 1 AS found, length(s_suppkey::VARCHAR) AS n FROM supplier),
t AS (SELECT count(*) AS requests, count(*) FILTER (c IN (0)) AS rejected_empty, count(*) FILTER (c = 1) AS rejected_too_short, count(*) FILTER (c = 2) AS rejected_scheme_not_allowed, count(*) FILTER (c = 3) AS rejected_no_domain,
    count(*) FILTER (c = 4) AS rejected_invalid_domain, 0::BIGINT AS rejected_length FROM s),
r AS (SELECT 4 * count(*) AS asked, count(*) FILTER (found) + 2 * count(*) AS retrieved, count(*) FILTER (NOT home) AS raised, sum(CASE WHEN home THEN 20 + n ELSE 0 END + 65 + n + 29)::BIGINT AS bytes,
    count(*) AS asked_homepage, count(*) FILTER (found) AS retrieved_homepage, count(*) AS asked_robots, count(*) AS retrieved_robots, count(*) AS asked_sitemap, 0::BIGINT AS retrieved_sitemap, count(*) AS asked_extra, count(*) AS retrieved_extra FROM s WHERE ok),
p AS (SELECT count(*) FILTER (home) AS made, 0::BIGINT AS failed FROM s WHERE ok)
SELECT 'requests' AS name, metric, n FROM (UNPIVOT t ON * INTO NAME metric VALUE n) UNION ALL SELECT 'resources', metric, n FROM (UNPIVOT r ON * INTO NAME metric VALUE n) UNION ALL SELECT 'reports', metric, n FROM (UNPIVOT p ON * INTO NAME metric VALUE n)"""


def audit_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of all pages: in the second, every third title is new, every fourth main heading gone, every seventh page moved."""
    pages = table(spark, sf_dir, "pages")
    title = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("html", "<title>", "<title>New ")).otherwise(F.col("html"))
    after = pages.select("page_id", "url", F.when(F.col("page_id") % 4 == 1, F.regexp_replace(title, "(</?)h1>", "$1h3>")).otherwise(title).alias("html"))
    key = lambda df, moved: captured_evidence(df).withColumn("page", F.when(F.col("audit_id").cast("long") % 7 == 0, F.concat(F.lit(moved), "audit_id")).otherwise(F.col("audit_id")))
    return changes(key(pages, ""), key(after, "moved "), "page", ("page_title", "page_language", "h1_tags"))


_CHANGES_SQL = f"""WITH p AS (SELECT page_id AS k, page_id::VARCHAR AS page, {_TITLE} AS t, to_json([trim({_DECODED.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")})])::VARCHAR AS h FROM pages)
SELECT page, 'removed' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM p WHERE k % 7 = 0 UNION ALL SELECT 'moved ' || page, 'added', NULL, NULL, NULL FROM p WHERE k % 7 = 0
UNION ALL SELECT page, 'changed', 'page_title', t, 'New ' || t FROM p WHERE k % 7 > 0 AND k % 3 = 0
UNION ALL SELECT page, 'changed', 'h1_tags', h, '[]' FROM p WHERE k % 7 > 0 AND k % 4 = 1"""


def audits_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event, as an audit of its user's site: the audit before it."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("url"), F.col("ts").alias("created_at"), F.col("event_id").alias("audit_id"), "event_type")
    return audit_before(e, e, keep=("audit_id", "event_type"), span="week").select("audit_id", "before_audit_id", "before_event_type", F.unix_micros("before_created_at").alias("before_us"))


_BEFORE_SQL = """SELECT a.event_id AS audit_id, b.k.i AS before_audit_id, b.k.e AS before_event_type, epoch_us(b.k.ts) AS before_us FROM events a LEFT JOIN (
  SELECT x.event_id, max(struct_pack(ts := y.ts, i := y.event_id, e := y.event_type)) AS k FROM events x JOIN events y ON x.user_id = y.user_id AND y.ts < x.ts GROUP BY x.event_id) b USING (event_id)"""


# --- One site ---------------------------------------------------------------------------------------------------------


def _host(k: str) -> str:
    return f"(case when ({k}) % 3 = 0 then 'https://big.example.com' else 'https://h' || (({k}) % 40) || '.example.com' end)"


def _page(k: str) -> str:
    return f"({_host(k)} || '/p' || ({k}))"


_HALF = "(k - k % 2) / 2"
#: What pages say in JSON-LD, by k % 6.
_JSON_LD = """case k % 6 when 1 then '{"@type": "Product", "name": "n' || k || '"}' when 2 then '{"@type": "Product", "name": null}' when 3 then '{"@graph": [{"@type": "Organization", "name": "o", "url": "u"}, {"@type": ["WebSite", "Thing"], "name": "w"}]}'
  when 4 then '{"@type": "Product"' when 5 then '[{"@type": "Article"}, {}]' end"""
#: Attributes repeated (the first counts), entities, a comment, tags that stay open.
_SITE = f"""'<html lang="en" lang="de"><head><title>Part ' || k || ' &amp; co</title>' || case when k % 10 = 4 then '<link rel="canonical" href="' || {_page("k - 1")} || '">' else '' end
  || '<meta name="robots" content="index">' || coalesce('<script type="application/ld+json">' || {_JSON_LD} || '</script>', '') || '</head><body><h1>Part &lt;' || k || '&gt;<h2>No end<p><!-- <a href="/no"> --><a href="' || {_page("2 * k + 1")} || '" href="/no">a<a href="' || {_page("2 * k + 2")} || '#part">b</a>'
  || '<a href="' || {_page("{half}")} || '">up</a><a href="/own?q=' || (k % 5) || '&amp;r=1#x">own</a><a href="#top">t</a><a href="mailto:a@b.c">m</a><p>' || p_name || ' <![CDATA[' || k || ']]></body>'"""


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, url, status_code, is_fetched, final_url, html`` of every page of the site."""
    p = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_type", "p_size"), "k")
    final = f"case when k % 17 = 3 or k % 50 = 20 then {_page('k + 1')} when k % 50 = 21 then {_page('k - 1')} else {_page('k')} end"
    return p.selectExpr("k", f"{_page('k')} as url", "case when k % 19 = 7 then 0 when k % 13 = 5 then 404 else 200 end as status_code", "k % 19 <> 7 as is_fetched", f"{final} as final_url", f"{_SITE.replace('{half}', '(k div 2)')} as html", "p_name", "p_type", "p_size")


#: The site's distinct links in SQL, of all pages, with the number of the page.
_EDGES = f"""SELECT DISTINCT k, {_page("k")} AS page, unnest([{_page("2 * k + 1")}, {_page("2 * k + 2")}, {_page("(k // 2)")}, {_host("k")} || '/own?q=' || (k % 5) || '&r=1']) AS link FROM (SELECT p_partkey AS k FROM part)"""
_STATUS = f"""SELECT {_page("k")} AS url, CASE WHEN k % 19 = 7 OR k % 13 = 5 THEN 'dead' WHEN k % 17 = 3 OR k % 50 IN (20, 21) THEN 'redirected' ELSE 'ok' END AS state FROM (SELECT p_partkey AS k FROM part)"""
CRAWL_BUDGET, CRAWL_DEPTH = 60, 7


def site_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl from the first page reaches, at most ``CRAWL_BUDGET`` pages a host; only pages that were answered have links."""
    pages = site_pages(spark, sf_dir)
    seeds = pages.filter("k = 0").select(normal_url(F.col("url")).alias("url"))
    return crawl(page_links(pages.filter("status_code = 200")).select("page", "link"), seeds, CRAWL_BUDGET, CRAWL_DEPTH)


def _crawl_sql() -> str:
    """One common table expression a round: budgets need what all rounds before took."""
    own = "regexp_extract(link, '^https?://([^/?#]*)', 1)"
    out = [f"e AS (SELECT page, link FROM ({_EDGES}) WHERE k % 19 <> 7 AND k % 13 <> 5)", f"r0 AS (SELECT {_page('0')} AS url, 'big.example.com' AS host, 0 AS depth, NULL::VARCHAR AS found_on)"]
    for d in range(1, CRAWL_DEPTH + 1):
        seen = " UNION ALL ".join(f"SELECT url, host FROM r{i}" for i in range(d))
        out.append(f"""s{d} AS ({seen}), r{d} AS (SELECT url, host, {d} AS depth, found_on FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) AS i FROM (
            SELECT link AS url, {own} AS host, min(page) AS found_on FROM r{d - 1} JOIN e ON page = url WHERE link NOT IN (SELECT url FROM s{d}) GROUP BY link)) x
          WHERE i <= {CRAWL_BUDGET} - (SELECT count(*) FROM s{d} WHERE s{d}.host = x.host))""")
    return f"WITH {', '.join(out)} {' UNION ALL '.join(f'SELECT url, host, depth::INTEGER AS depth, found_on FROM r{d}' for d in range(CRAWL_DEPTH + 1))}"


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page by what became of their targets."""
    pages = site_pages(spark, sf_dir)
    statuses = pages.select(normal_url(F.col("url")).alias("url"), "status_code", "is_fetched", "final_url")
    return link_report(link_states(page_links(pages).select("page", "link"), statuses))


_BROKEN_SQL = f"""SELECT page, count(*) AS n_links, count(*) FILTER (state = 'dead') AS n_dead, count(*) FILTER (state IS NULL) AS n_unknown, count(*) FILTER (state = 'redirected') AS n_redirected
FROM ({_EDGES}) e LEFT JOIN ({_STATUS}) s ON link = url GROUP BY page"""


def url_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the site's moved URLs and those with another canonical one end."""
    pages = site_pages(spark, sf_dir).withColumn("canonical_url", parsed(F.col("url"), F.col("html"))["canonical_url"])
    return url_chains(url_hops(pages))


def _chains_sql(canonical: bool = True) -> str:
    return f"""WITH RECURSIVE h AS (SELECT {_page("k")} AS url, CASE WHEN k % 17 = 3 OR k % 50 = 20 THEN {_page("k + 1")} WHEN k % 50 = 21 {'OR k % 10 = 4' if canonical else ''} THEN {_page("k - 1")} END AS next FROM (SELECT p_partkey AS k FROM part)),
g AS (SELECT * FROM h WHERE next IS NOT NULL),
w AS (SELECT url, next AS r, [next] AS path FROM g UNION ALL SELECT w.url, g.next, list_append(path, g.next) FROM w JOIN g ON g.url = r WHERE NOT list_contains(path, g.next)),
last AS (SELECT url, arg_max(r, len(path)) AS r, max(len(path)) AS n, arg_max(path, len(path)) AS path FROM w GROUP BY url)
SELECT last.url, CASE WHEN g.url IS NULL THEN r ELSE list_min(path[list_position(path, g.next):]) END AS representative, CASE WHEN g.url IS NULL THEN n END AS n_hops, g.url IS NOT NULL AS in_loop FROM last LEFT JOIN g ON g.url = r"""


#: robots.txt of the large host, and of the others.
_RULES = {"big": ["Disallow: /own", "Allow: /own?q=3", "Disallow: /*7$", "Allow: /p1", "Disallow: /p1*2$"], "other": ["Disallow: /p", "Allow: /p*4", "Disallow: /*q=*r=", "Allow: /own?q=1&r=1$", "Disallow: /p2000"]}


def site_robots(pages: DataFrame) -> DataFrame:
    """The robots.txt of every host of the site."""
    text = {name: "User-agent: *\n" + "\n".join(rules) for name, rules in _RULES.items()}
    host = F.regexp_extract("url", "^https://[^/]+", 0)
    robots = pages.select(host.alias("root")).distinct().select(F.concat("root", F.lit("/robots.txt")).alias("url"), F.when(F.col("root").contains("big"), text["big"]).otherwise(text["other"]).alias("content"))
    return robots_of(robots.selectExpr("'' as audit_id", "'robots' as kind", "url", "content", "200 as status_code", "true as is_success", "true as is_fetched"))


def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of the site by what its host's robots.txt says of it."""
    pages = site_pages(spark, sf_dir)
    return crawlability(page_links(pages).select("page", "link"), site_robots(pages))


def _rules_sql(links: str = _EDGES) -> str:
    pattern = lambda p: "^" + re.sub(r"([.?+()\[\]])", r"\\\1", p.removesuffix("$")).replace("*", ".*") + ("$" if p.endswith("$") else "")
    rows = ", ".join(f"({'true' if name == 'big' else 'false'}, '{rule}', {len(rule.split(': ')[1])}, {'true' if rule[0] == 'A' else 'false'}, '{pattern(rule.split(': ')[1])}')" for name, rules in _RULES.items() for rule in rules)
    return f"""WITH e AS ({links}), r(big, rule, n, allow, regex) AS (VALUES {rows}),
    m AS (SELECT link, max(struct_pack(n := n, allow := allow, rule := rule)) AS r FROM (SELECT DISTINCT link FROM e) JOIN r ON r.big = (link LIKE 'https://big.%') AND regexp_matches(regexp_extract(link, '^https://[^/]+(.*)$', 1), regex) GROUP BY link)
    SELECT page, e.link, coalesce(r.allow, true) AS allowed, r.rule AS rule FROM e LEFT JOIN m USING (link)"""


def structured_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all JSON-LD blocks of the site, with what they lack."""
    found = structured_items(json_ld(site_pages(spark, sf_dir)).select("k", "json_ld"), "k")
    return found.withColumn("missing", F.array_join("missing", ","))


_STRUCTURED_SQL = """SELECT k, 0::INTEGER AS block, x.item::INTEGER AS item, x.type AS type, x.missing AS missing, x.bad AS malformed FROM (SELECT p_partkey AS k, unnest(CASE p_partkey % 6
  WHEN 1 THEN [{'item': 0, 'type': 'Product', 'missing': '', 'bad': false}] WHEN 2 THEN [{'item': 0, 'type': 'Product', 'missing': 'name', 'bad': false}]
  WHEN 3 THEN [{'item': 0, 'type': 'Organization', 'missing': '', 'bad': false}, {'item': 1, 'type': 'WebSite', 'missing': 'url', 'bad': false}, {'item': 1, 'type': 'Thing', 'missing': '', 'bad': false}]
  WHEN 4 THEN [{'item': NULL, 'type': NULL, 'missing': '', 'bad': true}] WHEN 5 THEN [{'item': 0, 'type': 'Article', 'missing': 'headline', 'bad': false}, {'item': 1, 'type': NULL, 'missing': '', 'bad': false}] END) AS x FROM part)"""


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the site by how many others link to them."""
    pages = site_pages(spark, sf_dir)
    return orphans(pages.select(normal_url(F.col("url")).alias("page")), page_links(pages))


_ORPHANS_SQL = f"""WITH e AS ({_EDGES}), n AS (SELECT link, count(*) AS n FROM e WHERE page <> link GROUP BY link)
SELECT {_page("p_partkey")} AS page, coalesce(n, 0)::BIGINT AS n_in, n IS NULL AS is_orphan FROM part LEFT JOIN n ON link = {_page("p_partkey")}"""
AUTHORITY_ROUNDS = 6


def page_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authority of the site's pages after ``AUTHORITY_ROUNDS`` rounds."""
    pages = site_pages(spark, sf_dir)
    scores = authority_scores(pages.select(normal_url(F.col("url")).alias("page")), page_links(pages), most_rounds=AUTHORITY_ROUNDS)
    return scores.select("page", F.round("score", 10).alias("score"))


def _authority_sql() -> str:
    rounds = ", ".join(
        f"""s{i} AS (SELECT p.page, (0.15 + 0.85 * (SELECT coalesce(sum(s) FILTER (n_out = 0), 0) FROM s{i - 1})) / (SELECT count(*) FROM p) + 0.85 * coalesce(g, 0) AS s, n_out FROM p LEFT JOIN (
          SELECT link, sum(s / n_out) AS g FROM e JOIN s{i - 1} USING (page) GROUP BY link) ON link = p.page)"""
        for i in range(1, AUTHORITY_ROUNDS + 1)
    )
    return f"""WITH k AS (SELECT {_page("p_partkey")} AS page FROM part), e AS (SELECT page, link FROM ({_EDGES}) WHERE page <> link AND link IN (SELECT page FROM k)),
    p AS (SELECT k.page, count(link) AS n_out FROM k LEFT JOIN e USING (page) GROUP BY k.page), s0 AS (SELECT page, 1.0::DOUBLE / (SELECT count(*) FROM p) AS s, n_out FROM p), {rounds}
    SELECT page, round(s, 10) AS score FROM s{AUTHORITY_ROUNDS}"""


def content_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, thin pages and repeated text of every host of ``pages``, counted exactly."""
    return content_by_host(table(spark, sf_dir, "pages")).withColumn("repeated_share", F.round("repeated_share", 9))


_CONTENT_SQL = r"""WITH w AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS host,
    list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[a-z/!?][^>]*>', ' ', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM pages),
g AS (SELECT page_id, host, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
d AS (SELECT host, count(DISTINCT g) AS distinct_windows, count(DISTINCT (page_id, g)) AS n_windows FROM g GROUP BY host),
p AS (SELECT host, count(*) AS n_pages, count(*) FILTER (len(w) < 300) AS n_thin, sum(len(w))::BIGINT AS n_words FROM w GROUP BY host)
SELECT host, n_pages, n_thin, n_words, coalesce(n_windows, 0) AS n_windows, coalesce(distinct_windows, 0) AS distinct_windows, CASE WHEN n_windows > 0 THEN round(greatest(0, 1 - distinct_windows::DOUBLE / n_windows), 9) END AS repeated_share FROM p LEFT JOIN d USING (host)"""


def action_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30-day plans of all suppliers' sites, half an hour a day."""
    plan = action_plan(findings(evidence(shop_resources(spark, sf_dir))), "audit_id", day_minutes=30)
    return plan.select(F.col("audit_id").cast("long").alias("s_suppkey"), "issue", F.col("minutes").cast("long").alias("minutes"), *[F.col(c).cast("long").alias(c) for c in ("first_day", "last_day", "week")])


def _plan_sql(day: int) -> str:
    return f"""WITH RECURSIVE f AS ({_FINDINGS_SQL}), m AS (SELECT *, CASE issue WHEN 'Homepage Not Available' THEN 120 WHEN 'No Sitemap' THEN 60 WHEN 'Images Without ALT Attribute' THEN 2 ELSE 10 END AS minutes,
    row_number() OVER (PARTITION BY s_suppkey ORDER BY priority, issue) AS i FROM f),
t AS (SELECT s_suppkey, 0 AS i, ''::VARCHAR AS issue, 0 AS minutes, 1 AS first_day, 1 AS last_day, 0 AS used FROM (SELECT DISTINCT s_suppkey FROM m)
  UNION ALL SELECT m.s_suppkey, m.i::INTEGER, m.issue, m.minutes, CASE WHEN used + m.minutes <= {day} THEN t.last_day ELSE t.last_day + 1 END, CASE WHEN used + m.minutes <= {day} THEN t.last_day ELSE t.last_day + (m.minutes + {day} - 1) // {day} END,
    CASE WHEN used + m.minutes <= {day} THEN used + m.minutes ELSE m.minutes - {day} * ((m.minutes + {day} - 1) // {day} - 1) END FROM t JOIN m ON m.s_suppkey = t.s_suppkey AND m.i = t.i + 1)
SELECT s_suppkey, issue, minutes::BIGINT AS minutes, first_day::BIGINT AS first_day, last_day::BIGINT AS last_day, ((first_day - 1) // 7 + 1)::BIGINT AS week FROM t WHERE i > 0"""


def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve sections of all suppliers' reports."""
    return report_sections(evidence(shop_resources(spark, sf_dir))).withColumn("s_suppkey", F.col("audit_id").cast("long")).drop("audit_id")


def _parts_sql() -> str:
    q = lambda text: "'" + text.replace("'", "''") + "'"
    known = {
        ("Technical SEO", "HTTP Status"): "ok", ("Technical SEO", "HTTPS"): "true", ("Technical SEO", "Robots.txt"): "CASE WHEN r THEN NOT fifth END", ("Technical SEO", "Sitemap"): "even",
        ("Technical SEO", "Canonical"): "CASE WHEN ok THEN even END", ("On-Page SEO", "Title"): "CASE WHEN ok THEN true END", ("On-Page SEO", "Meta Description"): "CASE WHEN ok THEN third END",
        ("On-Page SEO", "H1"): "CASE WHEN ok THEN true END", ("On-Page SEO", "Image ALT"): "CASE WHEN ok THEN false END", ("Accessibility", "Missing ALT"): "CASE WHEN ok THEN false END", ("Security", "HTTPS"): "true",
    }
    every = [(cat, name, known.get((cat, name), "NULL::BOOLEAN")) for cat, names in CHECKS.items() for name in names]
    detailed = ", ".join(f"{q(f'- {cat}, {name}: ')} || CASE WHEN {e} THEN 'Pass' WHEN NOT ({e}) THEN 'Fail' ELSE 'Could not be verified in this audit.' END" for cat, name, e in every)
    holds = ", ".join(f"CASE WHEN {e} THEN {q(name)} END" for cat, name, e in every if (cat, name) in known and cat != "Security")
    issues = ", ".join(f"({', '.join(map(q, (said[0], cat, *said[2:6])))})" for (cat, _), said in [*_ISSUES.items(), (("On-Page SEO", "Meta Description"), _LENGTH_ISSUE)])
    severities = ", ".join(f"{q(f'- {name} ({when}): ')} || coalesce(n_{name.lower()}, 0)" for name, (_, _, when) in SEVERITIES.items())
    counts = ", ".join(f"count(*) FILTER (severity = {q(name)}) AS n_{name.lower()}" for name in SEVERITIES)
    by = lambda e, sep="chr(10)": f"string_agg({e}, {sep} ORDER BY priority, issue)"
    rec = """'- Issue: ' || issue || chr(10) || '- Business Impact: ' || impact || chr(10) || '- Why It Matters: ' || why || chr(10) || '- Recommended Fix: ' || recommendation || chr(10) || '- Implementation Difficulty: '
      || CASE WHEN issue IN ('Homepage Not Available', 'No Sitemap') THEN 'Medium' ELSE 'Easy' END || chr(10) || '- Estimated Time: ' || effort || chr(10) || '- Expected SEO Benefit: Ends this: ' || impact"""
    bodies = [
        "'Website: ' || u",
        """concat_ws(' ', 'The audit of ' || u || ' found ' || coalesce(n, 0) || ' issues, ' || coalesce(n_critical, 0) || ' of them critical and ' || coalesce(n_high, 0) || ' of high severity.', 'Checks that hold: ' || holds || '.',
          'Weaknesses: ' || weak || '.', 'Business risks: ' || risks || '.', 'Do first: ' || tops || '.', CASE WHEN n > 0 THEN 'Fix these in the order of the plan and audit the site again.' ELSE 'Keep the site as it is and audit it again when it changes.' END)""",
        """concat_ws(chr(10), '- Final URL: ' || u, '- HTTP status: ' || CASE WHEN ok THEN 200 ELSE 503 END, '- Title: ' || CASE WHEN ok THEN 'Shop ' || k ELSE 'not given' END, '- Description: ' || CASE WHEN ok AND third THEN 'About ' || k ELSE 'not given' END,
          '- Language: ' || CASE WHEN ok THEN 'en' ELSE 'not given' END, '- Internal links: ' || CASE WHEN ok THEN 3 ELSE 0 END, '- External links: ' || CASE WHEN ok THEN 2 ELSE 0 END, '- Images: ' || CASE WHEN ok THEN 4 ELSE 0 END)""",
        "'Could not be verified in this audit.'", f"CASE WHEN n > 0 THEN concat_ws(chr(10), {severities}) END", f"concat_ws(chr(10), {detailed})", "recs",
        "'#### Week 1' || chr(10) || chr(10) || plan", "tasks", "impacts", f"concat_ws(chr(10), {', '.join(q('- ' + x) for x in UNVERIFIABLE_FIELDS)})",
        "'- Audit: ' || k || chr(10) || '- Format: 1.0' || chr(10) || '- Issues: ' || coalesce(n, 0)",
    ]
    rows = ", ".join(f"{{'seq': {i}, 'title': {q(t)}, 'body': coalesce({b}, 'Nothing to report in this section.')}}" for i, (t, b) in enumerate(zip(SECTIONS, bodies, strict=True), 1))
    return f"""WITH s AS (SELECT s_suppkey, s_suppkey::VARCHAR AS k, 'https://shop' || s_suppkey || '.example.com' AS u, s_suppkey % 7 <> 6 AS ok, s_suppkey % 4 <> 3 AS r, s_suppkey % 2 = 0 AS even, s_suppkey % 3 = 0 AS third, s_suppkey % 5 = 0 AS fifth FROM supplier),
    t(issue, category, impact, why, fix, effort) AS (VALUES {issues}), f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY priority, issue) AS i FROM ({_FINDINGS_SQL}) JOIN t USING (issue)),
    d AS (SELECT s_suppkey, string_agg('- Day ' || first_day || CASE WHEN last_day > first_day THEN '–' || last_day ELSE '' END || ': ' || issue || ' (' || severity || ', ' || minutes || ' minutes)', chr(10) ORDER BY first_day, last_day, priority, issue) AS plan
      FROM ({_plan_sql(120)}) JOIN f USING (s_suppkey, issue) GROUP BY s_suppkey),
    a AS (SELECT s_suppkey, count(*) AS n, {counts}, {by("issue", "', '")} AS weak, {by("CASE WHEN i <= 5 THEN impact END", "'; '")} AS risks, {by("CASE WHEN i <= 5 THEN recommendation END", "'; '")} AS tops, {by(rec, "chr(10) || chr(10)")} AS recs,
      {by("CASE WHEN category IN ('Technical SEO', 'Performance', 'Security') THEN '- ' || recommendation || ' (' || effort || ')' END")} AS tasks, {by("'- ' || severity || ': ' || impact")} AS impacts FROM f GROUP BY s_suppkey),
    w AS (SELECT s.*, a.* EXCLUDE (s_suppkey), plan, nullif(concat_ws(', ', {holds}), '') AS holds FROM s LEFT JOIN a USING (s_suppkey) LEFT JOIN d USING (s_suppkey))
    SELECT s_suppkey, x.seq::INTEGER AS seq, x.title AS title, x.body AS body FROM (SELECT s_suppkey, unnest([{rows}]) AS x FROM w)"""


def site_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site-wide checks of every page of the site."""
    pages = site_pages(spark, sf_dir)
    return site_check_statuses(pages, site_robots(pages)).withColumn("seq", F.col("seq").cast("long"))


_CHECKS = f"""WITH k AS (SELECT p_partkey AS k, {_page("p_partkey")} AS page, NOT (p_partkey % 19 = 7 OR p_partkey % 13 = 5) AS ok FROM part), e AS (SELECT DISTINCT page, link FROM ({_EDGES}) WHERE k % 19 <> 7 AND k % 13 <> 5),
d AS (SELECT page, count(*) FILTER (state = 'dead') AS n FROM e LEFT JOIN ({_STATUS}) s ON link = url GROUP BY page), o AS (SELECT link, count(*) AS n FROM e WHERE page <> link GROUP BY link),
f AS (SELECT * FROM ({_chains_sql(False)})), c AS (SELECT * FROM ({_chains_sql()})),
x AS (SELECT k.*, coalesce(f.n_hops <= 1 AND NOT f.in_loop, f.url IS NULL) AS redirects, coalesce(c.representative = page, true) AS alone, r.allow AS allowed, coalesce(d.n, 0) = 0 AS unbroken, o.n IS NOT NULL AS linked, CASE k % 6 WHEN 0 THEN NULL ELSE k % 6 = 1 END AS data
  FROM k LEFT JOIN f ON f.url = page LEFT JOIN c ON c.url = page LEFT JOIN d USING (page) LEFT JOIN o ON o.link = page JOIN allowed r USING (page))
SELECT page, s.c AS category, s.i::BIGINT AS seq, s.n AS check, CASE WHEN s.h THEN 'Pass' WHEN NOT s.h THEN 'Fail' END AS status FROM (SELECT page, unnest([{{'c': 'Technical SEO', 'i': 6, 'n': 'Redirects', 'h': redirects}}, {{'c': 'Technical SEO', 'i': 7, 'n': 'Indexability', 'h': ok AND allowed AND alone}},
  {{'c': 'Technical SEO', 'i': 8, 'n': 'Crawlability', 'h': allowed}}, {{'c': 'Technical SEO', 'i': 9, 'n': 'Duplicate URLs', 'h': alone}}, {{'c': 'Technical SEO', 'i': 10, 'n': 'Broken Links', 'h': CASE WHEN ok THEN unbroken END}}, {{'c': 'Technical SEO', 'i': 11, 'n': 'Structured Data', 'h': CASE WHEN ok THEN data END}},
  {{'c': 'Technical SEO', 'i': 12, 'n': 'Meta Robots', 'h': CASE WHEN ok THEN true END}}, {{'c': 'Technical SEO', 'i': 14, 'n': 'Internal Linking', 'h': linked}}, {{'c': 'Content Quality', 'i': 5, 'n': 'Thin Content', 'h': CASE WHEN ok THEN false END}}]) AS s FROM x)"""


def _statuses_sql() -> str:
    pages = f"SELECT {_page('p_partkey')} AS page, {_page('p_partkey')} AS link FROM part"
    return _CHECKS.replace("WITH k AS", f"WITH allowed AS (SELECT page, allowed AS allow FROM ({_rules_sql(pages)})), k AS", 1)


QUERIES = {f.__name__: f for f in (run_counters, audit_changes, audits_before, site_crawl, broken_links, url_representatives, link_rules, structured_data, orphan_pages, page_authority, content_hosts, action_plans, report_parts, site_statuses)}

ORACLES = {
    "run_counters": _COUNTERS_SQL,
    "audit_changes": _CHANGES_SQL,
    "audits_before": _BEFORE_SQL,
    "site_crawl": _crawl_sql(),
    "broken_links": _BROKEN_SQL,
    "url_representatives": _chains_sql(),
    "link_rules": _rules_sql(),
    "structured_data": _STRUCTURED_SQL,
    "orphan_pages": _ORPHANS_SQL,
    "page_authority": _authority_sql(),
    "content_hosts": _CONTENT_SQL,
    "action_plans": _plan_sql(30),
    "report_parts": _parts_sql(),
    "site_statuses": _statuses_sql(),
}

"""Crawls, broken links and URL chains against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import html as html_module
from siftwell.operators.html import parse_page, parsed_links
from siftwell.operators.skew import dealt, first_of, salted_join
from siftwell.plans.crawl import crawl, link_report, link_states, page_links, url_chains, url_hops
from siftwell.queries import shop_resources
from siftwell.site_queries import site_pages


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_salted_join_is_a_join(spark, how, hot):
    r = random.Random(hot)
    left = spark.createDataFrame([(r.choice(["h", "h", "h", "x", "y", None, f"k{i}"]), i, "p") for i in range(200)], "k string, i long, `__x` string")
    right = spark.createDataFrame([(k, k * 2) for k in ["h", "x", *(f"k{i}" for i in range(0, 200, 3)), "z"]], "k string, v string")
    rows = lambda df: Counter(map(str, map(tuple, df.select(sorted(df.columns)).collect())))
    assert rows(salted_join(left, right, "k", how, hot)) == rows(left.join(right, "k", how))


def test_first_of_ranks_in_parts(spark):
    df = spark.range(5000).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.xxhash64("id").alias("v"))
    got = {(x.k, x.v, x["rank"]) for x in first_of(df, "k", [F.col("v")], F.col("k") + 5, 7, parts=4).collect()}
    want, by = set(), {}
    for x in df.collect():
        by.setdefault(x.k, []).append(x.v)
    for k, v in by.items():
        want |= {(k, x, i) for i, x in enumerate(sorted(v)[: k + 5], 1)}
    assert got == want


def reach(edges, seeds, budget, depth):
    host = lambda u: u.split("/")[2]
    seen, used, cand = {}, Counter(), {s: None for s in seeds}
    for d in range(depth + 1):
        new = []
        for u in sorted(cand):
            if u not in seen and used[host(u)] < budget:
                used[host(u)] += 1
                seen[u] = (d, cand[u])
                new.append(u)
        cand = {}
        for p, q in edges:
            if p in new:
                cand[q] = min(cand.get(q, p), p)
    return seen


@pytest.mark.parametrize("budget", [1, 7, 1000])
def test_crawl(spark, tmp_path, budget):
    r = random.Random(budget)
    page = lambda: f"https://{r.choice(['big', 'big', 'big', 'a', 'b'])}.com/{r.randint(0, 60)}"
    edges = sorted({(page(), page()) for _ in range(260)})
    seeds = [edges[0][0], edges[0][0], "https://alone.com", None]
    links, start = spark.createDataFrame(edges, "page string, link string"), spark.createDataFrame([(s,) for s in seeds], "url string")
    want = reach(edges, {s for s in seeds if s}, budget, 5)
    got = crawl(links, start, budget, 5, str(tmp_path / "c")).collect()
    assert {x.url: (x.depth, x.found_on) for x in got} == want and len(got) == len(want)
    # Cut off after its third round, it goes on from there: what is written isn't made again.
    for d in range(3, 6):
        (tmp_path / "c" / f"round={d}" / "_SUCCESS").unlink(missing_ok=True)
    again = crawl(links.limit(0), start, budget, 5, str(tmp_path / "c"))
    assert {x.url: (x.depth, x.found_on) for x in again.collect()} == want


def test_crawl_of_nothing(spark, tmp_path):
    links = spark.createDataFrame([], "page string, link string")
    assert crawl(links, spark.createDataFrame([], "url string"), 5, 3, str(tmp_path / "x")).collect() == []


def test_links_and_states(spark):
    html = "<a href='/b/?q=1#f'>x<a href='/b/?q=1'>y<A HREF=//o.org/z>z<a href='https://sub.e.com/'>s<a href='mailto:x@y.z'>m<a>n<a href=''>e<a href='http://['>broken<base href='/q/'>"
    pages = spark.createDataFrame([("https://e.com/", html), ("https://f.com", None), (None, "<a href=/x>"), ("no url", "<a href=/x>")], "url string, html string")
    links = page_links(pages)
    assert {tuple(x) for x in links.collect()} == {("https://e.com", "https://e.com/b/?q=1", True), ("https://e.com", "https://o.org/z", False), ("https://e.com", "https://sub.e.com", True)}
    statuses = spark.createDataFrame(
        [("https://e.com/b/?q=1", 404, True, ""), ("https://o.org/z", 200, True, "https://o.org/z#top"), ("https://e.com", None, None, None), ("m", 301, True, "n"), ("d", 0, False, None), ("t", 200, True, "https://t.com/new")],
        "url string, status_code int, is_fetched boolean, final_url string",
    )
    more = links.select("page", "link").unionByName(spark.createDataFrame([("p", x) for x in ("m", "d", "t", "never", "https://e.com")], "page string, link string"))
    for hot in (0, 100_000):
        got = {x.link: x.state for x in link_states(more, statuses, hot_rows=hot).collect()}
        assert got == {"https://e.com/b/?q=1": "dead", "https://o.org/z": "ok", "https://sub.e.com": "unknown", "m": "redirected", "d": "dead", "t": "redirected", "never": "unknown", "https://e.com": "dead"}
    assert {tuple(x) for x in link_report(link_states(more, statuses)).collect()} == {("https://e.com", 3, 1, 1, 0), ("p", 5, 2, 1, 2)}


def test_links_alone_are_those_of_the_whole_parse(spark, monkeypatch):
    bits = ["<a href='/x?y=1#z'>", "<A HREF=b/c>", "<a href>", '<a href="" href=/2>', "<a href='#t'>", "<a href='mailto:x@y.z'>", "<a href='https://o.org/z?q#f'>", "<a href='//p.q/../r'>", "<a", '<p class="<a href=/no>">', "<p a='x'b>", "<p>", "</p>", "<br/>",
            '<img alt="', '"', ">", "<script>", "</script>", "<style>", "</style >", "<!-- <a href=/c> -->", "<!--", "-->", "<!-->", "<!--x--y-->", "<!", "<?", "&amp", "text", "</a ", "<li\0>", "<td", "=", "'", "<title>", "</>", "\n"]
    r = random.Random(5)
    pages = [(i, r.choice(["https://e.com/a/b?c", "https://e.com", "http://h:8/x#y", "none", "", None]), "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(3000)] + [(-1, "https://e.com", None)]
    got = spark.createDataFrame(pages, "i long, url string, html string").select("i", parsed_links(F.col("url"), F.col("html")).alias("l")).collect()
    found = {x.i: [y.asDict() for y in x.l] for x in got}
    # Against plain joining, too: what is resolved without it comes out the same.
    monkeypatch.setattr(html_module, "resolve", html_module._joined)
    assert found == {i: parse_page(u, h)["links"] for i, u, h in pages} and sum(map(len, found.values())) > 1000


def test_common_links_are_not_taken_apart(monkeypatch):
    html_module.resolve.cache_clear()
    monkeypatch.setattr(html_module, "_joined", lambda base, href: pytest.fail(href))
    assert [html_module.resolve("https://e.com/a", x) for x in ("https://o.org/z#f", "/b?q=1", "#t", "tel:+1")] == ["https://o.org/z#f", "https://e.com/b?q=1", "https://e.com/a#t", "tel:+1"]
    html_module.resolve.cache_clear()


@pytest.mark.parametrize("seed", range(4))
def test_chains(spark, seed):
    r = random.Random(seed)
    n = [0, 1, 40, 90][seed]
    nxt = {f"u{i}": f"u{r.choice([i + 1, i + 1, r.randrange(max(n, 1)), 5])}" for i in range(n) if r.random() < 0.9}
    nxt |= {f"l{i}": f"l{i + 1}" for i in range(37)} | {f"c{i}": f"c{(i + 1) % 11}" for i in range(11)} | {"into": "c3", "self": "self"}
    want = {}
    for u in nxt:
        path, at = [], u
        while at in nxt and at not in path:
            path.append(at)
            at = nxt[at]
        want[u] = (min(path[path.index(at) :]), None, True) if at in path else (at, len(path), False)
    got = url_chains(spark.createDataFrame(list(nxt.items()), "url string, next string"), hot_rows=seed * 3)
    assert {x.url: tuple(x)[1:] for x in got.collect()} == want


def test_hops(spark):
    rows = [("https://a.com/", "https://a.com", None), ("https://b.com", "https://c.com/x", "https://d.com"), ("https://e.com", None, "https://f.com/#t"), ("bad", "https://x.com", None), (None, None, None), ("https://g.com", "", "/relative")]
    got = url_hops(spark.createDataFrame(rows, "url string, final_url string, canonical_url string"))
    assert {tuple(x) for x in got.collect()} == {("https://b.com", "https://c.com/x"), ("https://e.com", "https://f.com")}
    assert url_chains(got.limit(0)).collect() == []


def test_rows_are_dealt_before_pages_are_made(spark, tmp_path):
    """A small table in one file is many tasks where a page is made of every row."""
    got = dealt(spark.range(0, 9000, 1, 1).toDF("k"), "k", most=500)
    assert got.rdd.getNumPartitions() == 18 and got.count() == got.distinct().count() == 9000
    assert dealt(spark.range(0).toDF("k"), "k").count() == 0
    spark.range(0, 4001, 1, 1).selectExpr("id as p_partkey", "'n' as p_name", "'t' as p_type", "1 as p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(0, 4001, 1, 1).selectExpr("id as s_suppkey", "'n' as s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert min(pages(spark, str(tmp_path)).rdd.getNumPartitions() for pages in (site_pages, shop_resources)) >= max(3, min(cores, 4001))

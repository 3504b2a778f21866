"""Crawlability, structured data, internal linking, content and plans against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators.content import content_by_host, page_words, windows
from siftwell.operators.crawlability import crawlability, robots_patterns
from siftwell.operators.structured import json_ld, structured_items
from siftwell.plans.action_plan import action_plan, effort_minutes, plan_markdown
from siftwell.plans.linking import authority_scores, orphans
from siftwell.schemas import ROBOTS


def robots(spark, *hosts):
    rows = [(f"https://{h}/robots.txt", (True, 200, list(d), list(a), [], False)) for h, d, a in hosts]
    return spark.createDataFrame(rows, f"url string, rules {ROBOTS}")


CASES = [
    ("/", True, None), ("/x", False, "Disallow: /x"), ("/xy/ok", True, "Allow: /xy/ok"), ("/a.php", False, "Disallow: /*.php$"), ("/a.php?q=1", True, None), ("/deep/b.php", False, "Disallow: /*.php$"),
    ("/tie", True, "Allow: /tie"), ("/q?id=3&x=1", False, "Disallow: /q?*x="), ("/q?id=3", True, None), ("/p+(1)", False, "Disallow: /p+(1)"), ("/p", True, None), ("/$1", False, "Disallow: /$1"),
    ("/nolead", False, "Disallow: /nolead"), ("/fish*", False, "Disallow: /fish*/*"), ("/fish/1/2", False, "Disallow: /fish*/*"),
]


@pytest.mark.parametrize("hot", [0, 100_000])
def test_crawlability(spark, hot):
    rules = robots(spark, ("e.com", ["/x", "/*.php$", "/tie", "/q?*x=", "/p+(1)", "/$1", "nolead # why", "/fish*/*", ""], ["/xy/ok", "/tie"]), ("none.com", [], []))
    rows = [(f"https://E.com{p}", i) for i, (p, *_) in enumerate(CASES)] + [("https://e.com", 90), ("https://none.com/x", 91), ("https://other.com/x", 92), (None, 93), ("https://e.com/x", 94)]
    got = {x.i: (x.allowed, x.rule) for x in crawlability(spark.createDataFrame(rows, "link string, i int"), rules, hot_rows=hot).collect()}
    want = {i: (a, r) for i, (p, a, r) in enumerate(CASES)} | {90: (True, None), 91: (True, None), 92: (True, None), 93: (True, None), 94: (False, "Disallow: /x")}
    want[13] = (True, None)  # a star in the URL is no second slash
    assert got == want


def plain_rule(rules, path):
    def hit(p):
        return re.match("(?s)" + re.escape(p.removesuffix("$")).replace(r"\*", ".*") + ("$" if p.endswith("$") else ""), path)

    found = [(len(p), a, p) for a, p in rules if hit(p)]
    return max(found, default=None)


def test_crawlability_of_random_patterns(spark):
    r = random.Random(1)
    some = lambda letters, n: "/" + "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    hosts = [(f"h{i}.com", {some("ab/*$", 5) for _ in range(8)}, {some("ab/*", 5) for _ in range(4)}) for i in range(5)]
    links = [(f"https://h{r.randrange(6)}.com{some('ab/', 8)}",) for _ in range(300)]
    rules = robots(spark, *hosts)
    patterns = {}
    for x in robots_patterns(rules).collect():
        patterns.setdefault(x.host, []).append((x.allow, x.pattern))
        assert x.pattern.startswith(x.literal) and "*" not in x.literal
    for x in crawlability(spark.createDataFrame(links, "link string"), rules).collect():
        host, path = x.link.removeprefix("https://").split("/", 1)
        best = plain_rule(patterns.get(host, []), "/" + path)
        assert (x.allowed, x.rule) == ((best[1], f"{'Allow' if best[1] else 'Disallow'}: {best[2]}") if best else (True, None))


def test_crawlability_meets_only_rules_that_begin_like_the_link(spark):
    df = crawlability(spark.createDataFrame([("https://e.com/x",)], "link string"), robots(spark, ("e.com", ["/x"], [])))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


HTML = [
    '<script type="application/ld+json">{"@type":"Product","name":"x"}</script><script type=APPLICATION/LD+JSON;charset=utf-8>{"@graph":[{"@type":["Article","Thing"]},{"@type":"Event","name":null,"location":{"a":1},"startDate":5},{"x":1}]}</script>',
    '<script type="application/ld+json">[{"@type":"Organization","url":""}, 5]</script><script type="application/ld+json">{bad</script><script>{"@type":"No"}</script><script type="application/ld+json">"str"</script><script type="application/ld+json"></script>',
    None,
    '<script type="application/ld+json">{"@type":"WebSite","name":"<b>&amp;</b>","url":"u"}',
    '<script type="application/ld+json">[]</script><script type="application/ld+json">{}</script>',
]


def test_structured_items(spark):
    df = spark.createDataFrame([(i, "https://e.com", h) for i, h in enumerate(HTML)], "id int, url string, html string")
    got = [tuple(x) for x in structured_items(json_ld(df), "id").orderBy("id", "block", "item", "type").collect()]
    assert got == [
        (0, 0, 0, "Product", [], False), (0, 1, 0, "Article", ["headline"], False), (0, 1, 0, "Thing", [], False), (0, 1, 1, "Event", ["name"], False), (0, 1, 2, None, [], False),
        (1, 0, 0, "Organization", ["name"], False), (1, 0, 1, None, [], False), (1, 1, None, None, [], True), (1, 2, None, None, [], True), (1, 3, None, None, [], True),
        (3, 0, None, None, [], True), (4, 0, None, None, [], False), (4, 1, 0, None, [], False),
    ]


@pytest.mark.parametrize("hot", [3, 100_000])
def test_authority(spark, hot):
    r = random.Random(2)
    names = [f"p{i}" for i in range(40)]
    edges = sorted({(r.choice(names[:30]), r.choice(names[:3] if r.random() < 0.4 else names)) for _ in range(150)} | {("hub", n) for n in names} | {("out", "p0"), ("p1", "away")})
    known = [*names, "hub", "alone"]
    at = {p: i for i, p in enumerate(known)}
    m = np.zeros((len(known), len(known)))
    for p, q in edges:
        if p in at and q in at and p != q:
            m[at[q], at[p]] = 1
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / len(known))
    x = np.full(len(known), 1 / len(known))
    for _ in range(500):
        x = 0.5 / len(known) + 0.5 * m @ x
    pages, links = spark.createDataFrame([(p,) for p in [*known, "p0", None]], "page string"), spark.createDataFrame(edges, "page string, link string")
    got = {y.page: y.score for y in authority_scores(pages, links, 0.5, hot_rows=hot).collect()}
    assert set(got) == set(known) and abs(sum(got.values()) - 1) < 1e-9 and max(abs(got[p] - x[i]) for p, i in at.items()) < 1e-6
    n_in = {p: sum(q == p and a != p and a in at for a, q in edges) for p in known}
    assert {(y.page, y.n_in, y.is_orphan) for y in orphans(pages, links).collect()} == {(p, n, n == 0) for p, n in n_in.items()}


def test_authority_goes_on_from_written_rounds(spark, tmp_path):
    pages, links = spark.createDataFrame([("a",), ("b",), ("c",)], "page string"), spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "page string, link string")
    whole = {x.page: x.score for x in authority_scores(pages, links, 0.5).collect()}
    authority_scores(pages, links, 0.5, most_rounds=4, path=str(tmp_path))
    again = {x.page: x.score for x in authority_scores(pages, links, 0.5, path=str(tmp_path)).collect()}
    assert all(abs(again[p] - s) < 1e-9 for p, s in whole.items())
    assert authority_scores(pages.limit(0), links).collect() == [] and orphans(pages.limit(0), links).collect() == []


def test_authority_rounds_join_numbers(spark, tmp_path):
    """URLs are joined twice, when links are numbered, and hot pages are looked for once; not so in every round."""
    pages, links = spark.createDataFrame([("a",), ("b",), ("c",)], "page string"), spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "page string, link string")
    assert {x.page for x in authority_scores(pages, links, 0.5, most_rounds=3, path=str(tmp_path), hot_rows=1).collect()} == {"a", "b", "c"}
    types = lambda name: dict(spark.read.parquet(str(tmp_path / name)).dtypes)
    assert types("inner") == {"source": "bigint", "target": "bigint"} and types("score=3")["id"] == "bigint" and spark.read.parquet(str(tmp_path / "hot")).count() == 1


def test_words_and_windows(spark):
    html = "<style>a b</style><p>One, <b>two</b>-three<!-- no --> 4 É<script>var x</script  > x < y"
    x = spark.createDataFrame([(html,), ("a b",), ("",), (None,)], "h string").select(page_words(F.col("h")).alias("w")).select("w", F.size(windows(F.col("w"), 3)).alias("n")).collect()
    assert [r.w for r in x] == [["one", "two", "three", "4", "é", "x", "y"], ["a", "b"], [], []] and [r.n for r in x] == [5, 1, 0, 0]


def test_content_by_host_within_the_bound(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    shared = [[word() for _ in range(400)] for _ in range(3)]
    pages = []
    for i in range(60):
        own = [word() for _ in range(r.randint(5, 900))]
        pages.append((f"https://h{i % 3}.com/{i}", "<p>" + " ".join(own + (shared[i % 3] if i % 2 else []))))
    pages += [("https://empty.com", None), ("https://h0.com/e", "")]
    exact, total = {}, {}
    for u, h in pages:
        w = (h or "")[3:].split()
        grams = {" ".join(w[i : i + 8]) for i in range(max(1, len(w) - 7))} if w else set()
        host = u.split("/")[2]
        exact.setdefault(host, set()).update(grams)
        total[host] = total.get(host, 0) + len(grams)
    df = spark.createDataFrame(pages, "url string, html string").repartition(7)
    for bits, bound in ((16, 0.0), (9, 4 * 2**-4.5)):
        got = {x.host: x for x in content_by_host(df, bits=bits).collect()}
        assert set(got) == set(exact)
        for host, x in got.items():
            assert x.n_windows == total[host] and abs(x.distinct_windows - len(exact[host])) <= bound * len(exact[host])
    assert got["h0.com"].n_thin == sum(len((h or "")[3:].split()) < 300 for u, h in pages if "//h0.com" in u) and got["empty.com"].repeated_share is None


def test_content_beyond_sketches(spark):
    """A host with more windows than the query's sketches had entries (2 ** 16) is counted exactly."""
    pages = [(f"https://e.com/{i}", " ".join(f"w{i % 70}x{j}" for j in range(1007))) for i in range(100)]
    x = content_by_host(spark.createDataFrame(pages, "url string, html string")).first()
    assert (x.n_windows, x.distinct_windows) == (100_000, 70_000) and abs(x.repeated_share - 0.3) < 1e-12


def test_effort(spark):
    said = {"5–10 minutes": 10, "1–2 hours": 120, "30 minutes": 30, "1–2 minutes an image": 2, "Depends on the cause": 120, "": 120, None: 120}
    assert {x.e: x.m for x in spark.createDataFrame([(e,) for e in said], "e string").select("e", effort_minutes(F.col("e")).alias("m")).collect()} == said


@pytest.mark.parametrize("seed", range(3))
def test_plan(spark, seed):
    r = random.Random(seed)
    names = ["Critical", "High", "Medium", "Low", "Information", None]
    rows = [(r.randrange(6), f"i{i}", r.choice(names), r.choice([0, 5, 60, 119, 120, 121, 600, None, 2000])) for i in range(80)] + [(99, "same", "High", 50)] * 4
    got = action_plan(spark.createDataFrame(rows, "audit int, issue string, severity string, cost int"), "audit", minutes="cost").collect()
    assert len(got) == len(rows)
    for a in {x[0] for x in rows}:
        mine = sorted((x for x in got if x.audit == a), key=lambda x: (names.index(x.severity), x.issue))
        day, used, load = 1, 0, {}
        for x in mine:
            m = 120 if x.cost is None else x.cost
            if used + m <= 120:
                first = day
                used += m
            else:
                first = day + 1
                n = max(1, -(-m // 120))
                day, used = first + n - 1, m - (n - 1) * 120
            if day <= 30:
                for d in range(first, day + 1):
                    load[d] = load.get(d, 0) + (m if first == day else 120 if d < day else used)
            assert (x.minutes, x.first_day, x.last_day, x.planned) == ((m, first, day, True) if day <= 30 else (m, None, None, False))
        assert all(n <= 120 for n in load.values())
    text = {x.audit: x.plan for x in plan_markdown(action_plan(spark.createDataFrame(rows[-4:], "audit int, issue string, severity string, cost int"), "audit", minutes="cost"), "audit").collect()}
    assert text == {99: "#### Week 1\n\n" + "\n".join(f"- Day {d}: same (High, 50 minutes)" for d in (1, 1, 2, 2))}

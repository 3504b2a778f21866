import pytest
from pyspark.sql import functions as F

from siftwell.functions.robots import robots_evidence, sitemaps_to_fetch
from siftwell.functions.sitemaps import loc_count
from siftwell.functions.text import split_lines

# text: disallow, allow, sitemaps in evidence, sitemaps to fetch, root blocked
CASES = [
    ("User-agent: *\nDisallow: /admin", ["/admin"], [], [], [], False),
    ("User-agent: *\nDisallow: /", ["/"], [], [], [], True),
    ("user-AGENT: *\nDISALLOW: /*\nallow: /a", ["/*"], ["/a"], [], [], True),
    ("User-agent: *\nUser-agent: Bot\nDisallow: /x", [], [], [], [], False),
    ("User-agent: Bot\nUser-agent: *\nDisallow: /x", ["/x"], [], [], [], False),
    ("User-agent: *\nDisallow: / # all", ["/ # all"], [], [], [], False),
    ("User-agent: *\nDisallow:", [], [], [], [], False),
    ("Disallow: /x", [], [], [], [], False),
    ("Sitemap: /sitemap.xml", [], [], ["/sitemap.xml"], [], False),
    ("  Sitemap: https://e.com/x.xml", [], [], ["https://e.com/x.xml"], [], False),
    ("Sitemap:\nhttps://e.com/s.xml", [], [], [], ["https://e.com/s.xml"], False),
    ("Sitemap: https://e.com/s.xml\nSITEMAP: https://e.com/s.xml", [], [], ["https://e.com/s.xml"] * 2, ["https://e.com/s.xml"], False),
    ("User-agent: *\r\nDisallow: /a\r\n\r\n# c\r\nDisallow: /b:c\r\n", ["/a", "/b:c"], [], [], [], False),
    ("User-agent: *\x0bDisallow: /v\x1cDisallow: /w Disallow: /u", ["/v", "/w", "/u"], [], [], [], False),
]


@pytest.mark.parametrize("case", CASES)
def test_rules(spark, case):
    text, disallow, allow, maps, fetch, blocked = case
    df = spark.createDataFrame([(text,)], "t string")
    x = df.select(robots_evidence(F.col("t"), F.lit(200), F.lit(True), F.lit(True)).alias("r"), sitemaps_to_fetch(F.col("t")).alias("f")).first()
    assert (x.r.disallow_rules, x.r.allow_rules, x.r.sitemap_urls, x.r.blocks_root_path) == (disallow, allow, maps, blocked)
    assert x.r.is_accessible and x.r.http_status == 200
    assert x.f == fetch


def test_gate(spark):
    df = spark.createDataFrame([("", 200, True, True), ("User-agent: *\nDisallow: /", 404, False, True), ("x", 0, False, False), (None, 200, True, True)], "t string, s int, ok boolean, got boolean")
    r = [x.r for x in df.select(robots_evidence(F.col("t"), F.col("s"), F.col("ok"), F.col("got")).alias("r")).collect()]
    assert [x and (x.is_accessible, x.http_status, x.disallow_rules, x.blocks_root_path) for x in r] == [(False, 200, [], False), (False, 404, [], False), None, (False, 200, [], False)]


@pytest.mark.parametrize("text", ["a\nb\r\nc\rd", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b c d", "\n\na\n"])
def test_split_lines(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(F.filter(split_lines(F.col("t")), lambda x: x != "")).first()[0]
    assert got == [x for x in text.splitlines() if x]


@pytest.mark.parametrize("xml,n", [("<urlset><url><loc>a</loc></url><url><loc\n>b</loc></url></urlset>", 2), ("<image:loc>x</image:loc>", 0), ("<!-- <loc>a</loc> --><loc>b</loc>", 1), ("<![CDATA[<loc>]]><loc/>", 1), ("not xml <loc>", 1), ("", 0), (None, 0), ("<location>x</location>", 0)])
def test_loc_count(spark, xml, n):
    assert spark.createDataFrame([(xml,)], "x string").select(loc_count(F.col("x"))).first()[0] == n

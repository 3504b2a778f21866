from pyspark.sql import functions as F

from siftwell.operators.evidence import evidence
from siftwell.operators.findings import findings
from siftwell.operators.sections import NOTHING, SECTIONS, issue_counts, n_words, report_sections, sections_markdown, within_words

from .test_findings import page, resources


def test_within_words(spark):
    df = spark.createDataFrame([(["one two.", "three four five.", "six."],), ([],), (["a " * 9 + "b."],), ([None, "", "x y."],)], "s array<string>")
    got = [r.t for r in df.select(within_words(F.col("s"), 5).alias("t")).collect()]
    assert got == ["one two. three four five.", "", "", "x y."]
    assert [r.t for r in df.select(within_words(F.col("s"), 4).alias("t")).collect()][0] == "one two."  # what follows a sentence that doesn't fit goes too


def test_counts_by_three_groupings(spark):
    rows = [("a", "High", "x"), ("a", "High", "y"), ("a", "Low", "x"), ("b", None, "x")]
    got = {r.k: (r.n_issues, r.by_severity, r.by_category) for r in issue_counts(spark.createDataFrame(rows, "k string, severity string, category string").filter("severity is not null"), "k").collect()}
    assert got == {"a": (3, {"High": 2, "Low": 1}, {"x": 2, "y": 1})}


def site(spark):
    return evidence(resources(
        spark,
        ("good", 0, "homepage", "https://e.com", 200, page("x" * 155)), ("good", 1, "robots", "https://e.com/robots.txt", 200, "User-agent: *"), ("good", 2, "sitemap", "https://e.com/sitemap.xml", 200, "<loc>"),
        ("bad", 0, "homepage", "http://b.com", 200, "<img src=x>"), ("bad", 1, "robots", "http://b.com/robots.txt", 200, "User-agent: *\nDisallow: /"), ("bad", 2, "sitemap", "http://b.com/sitemap.xml", 404, ""),
        ("down", 0, "homepage", "https://d.com", 503, ""),
    ))


def test_all_sections_in_order(spark):
    got = report_sections(site(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.audit_id, []).append(r)
    assert set(by) == {"good", "bad", "down"}
    for rows in by.values():
        rows.sort(key=lambda r: r.seq)
        assert [r.title for r in rows] == list(SECTIONS) and all(r.body for r in rows)
    text = {k: {r.title: r.body for r in rows} for k, rows in by.items()}
    empty = lambda k: {t for t, b in text[k].items() if b == NOTHING}
    assert empty("good") == {"Priority Matrix", "AI Recommendations", "30-Day Action Plan", "Developer Tasks", "Business Summary"} and empty("bad") == set()
    assert "found 0 issues" in text["good"]["Executive Summary"] and "Keep the site" in text["good"]["Executive Summary"]
    n = findings(site(spark)).filter("audit_id = 'bad'").count()
    assert f"found {n} issues, 1 of them critical" in text["bad"]["Executive Summary"] and text["bad"]["AI Recommendations"].count("- Issue: ") == n
    assert text["bad"]["AI Recommendations"].startswith("- Issue: Robots.txt Blocks the Whole Site\n- Business Impact: ") and "#### Week 1" in text["bad"]["30-Day Action Plan"]
    assert text["down"]["Detailed Audit"].count("\n") == 56 and "- Technical SEO, HTTP Status: Fail" in text["down"]["Detailed Audit"]
    assert text["bad"]["Overall SEO Score"] == "Could not be verified in this audit."


def test_summary_stays_within_its_words(spark):
    e = site(spark)
    for most in (400, 40, 12, 3):
        got = report_sections(e, summary_words=most).filter("seq = 2").select(n_words(F.col("body")).alias("n"), "body").collect()
        assert all(r.n <= most or r.body == NOTHING for r in got)


def test_same_evidence_same_report(spark):
    once, again = (sorted(map(tuple, sections_markdown(report_sections(site(spark).repartition(n))).collect())) for n in (1, 5))
    assert once == again and once[0][1].startswith("# SEO Audit Report\n\n## 1. Cover Page\n\nWebsite: ") and once[0][1].count("\n## ") == 12
    assert sections_markdown(report_sections(site(spark).limit(0))).collect() == []

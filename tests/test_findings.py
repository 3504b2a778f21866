from pyspark.sql import functions as F

from siftwell.operators import scoring
from siftwell.operators.evidence import evidence
from siftwell.operators.findings import CHECKS, ISSUE_FIELDS, check_statuses, findings
from siftwell.operators.render import evidence_text
from siftwell.schemas import RESOURCE


def resources(spark, *rows):
    """Rows of (audit, seq, kind, url, status, content)."""
    whole = [(a, seq, kind, url, kind, url, status, content, 200 <= status < 300, True, "") for a, seq, kind, url, status, content in rows]
    return spark.createDataFrame(whole, RESOURCE)


def page(description):
    return f'<html lang="en"><title>t</title><meta name="description" content="{description}"><link rel="canonical" href="/"><h1>h</h1></html>'


def test_description_lengths(spark):
    rows = [(str(n), 0, "homepage", "https://e.com", 200, page("x" * n)) for n in (0, 1, 149, 150, 160, 161)]
    got = {x.audit_id: (x.issue, x.severity, x.priority) for x in findings(evidence(resources(spark, *rows))).collect()}
    short = ("Meta Description Length", "Low", 4)
    assert got == {"0": ("Missing Meta Description", "High", 2), "1": short, "149": short, "161": short}


def test_issue_fields_and_counts(spark):
    e = evidence(resources(spark, ("a", 0, "homepage", "http://e.com", 200, ""), ("a", 1, "robots", "http://e.com/robots.txt", 200, "User-agent: *\nDisallow: /")))
    found = findings(e)
    assert found.columns == ["audit_id", "category", "check", *ISSUE_FIELDS]
    assert all(all(x) for x in found.collect())
    counts = scoring.severity_counts(found, "audit_id").first()
    assert (counts.n_critical, counts.n_high, counts.n_medium, counts.n_low) == (1, 3, 2, 0)
    assert [x.issue for x in scoring.top_findings(found, "audit_id", ["issue"], 2).orderBy("rank").collect()] == ["Robots.txt Blocks the Whole Site", "Missing Meta Description"]


def test_statuses_are_open_where_nothing_was_seen(spark):
    got = {(x.category, x.check): x.status for x in check_statuses(evidence(resources(spark, ("a", 0, "homepage", "https://e.com", 500, "")))).collect()}
    assert len(got) == sum(map(len, CHECKS.values()))
    assert {k for k, v in got.items() if v == "Fail"} == {("Technical SEO", "HTTP Status")}
    assert {k for k, v in got.items() if v == "Pass"} == {("Technical SEO", "HTTPS"), ("Security", "HTTPS")}


def test_findings_without_shuffle(spark):
    e = evidence(resources(spark, ("a", 0, "homepage", "https://e.com", 200, "")))
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(findings(e)) == count(e)


def test_audit_without_homepage(spark):
    rows = [("a", 1, "robots", "https://e.com/robots.txt", 200, "User-agent: *\nDisallow: /x"), ("a", 3, "extra", "https://other.com/s.xml", 200, "<loc>1</loc>"), ("b", 0, "homepage", "https://b.com", 200, "<title>B</title>")]
    got = {x.audit_id: x for x in evidence(resources(spark, *rows)).withColumn("text", evidence_text(F.col("base_url"))).collect()}
    a = got["a"]
    assert (a.base_url, a.final_url, a.http_status, a.is_https, a.page_title, a.page_title_length, a.h1_tags, a.internal_links) == ("https://e.com", "https://e.com", 0, True, None, 0, [], [])
    assert a.robots_txt.disallow_rules == ["/x"] and [m.url_count for m in a.sitemaps] == [1]
    assert "- HTTP Status: 0\n" in a.text and "- Disallow: /x" in a.text
    assert got["b"].page_title == "B" and got["b"].robots_txt is None and got["b"].sitemaps == []

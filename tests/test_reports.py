from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.config import Settings, read_settings
from siftwell.operators import scoring
from siftwell.operators import pdf
from siftwell.operators.blocks import EMPTY, cover_blocks, inline, markdown_blocks, md_blocks
from siftwell.operators.pdf import render_pdf
from siftwell.plans.audit import MISSING_KEY, captured_evidence, results, template_report, with_evidence_text, with_reports
from siftwell.schemas import REPORT
from siftwell.sources.captures import fetch, fetch_summary, further_sitemaps, planned_requests
from siftwell.sources.guidance import FILES, read_guidance
from siftwell.sources.reports import find_pdf, find_report, read_reports, read_reports_json, with_pdf, write_pdfs, write_reports, write_reports_json
from siftwell.streaming.evidence_stream import evidence_stream, page_stream, write_evidence


def shape(markdown):
    return [(b["kind"], b["level"], b["items"] or b["text"]) for b in markdown_blocks(markdown)]


BLOCKS = [
    (None, [("body", 0, EMPTY)]),
    (" \n ", [("body", 0, EMPTY)]),
    ("# A\n## B ##\n### C\n##### E", [("heading", 1, "A"), ("heading", 2, "B"), ("heading", 3, "C"), ("heading", 4, "E")]),
    ("T\n===\nU\n---", [("heading", 1, "T"), ("heading", 2, "U")]),
    ("one\ntwo\n\nthree", [("body", 0, "one<br/>\ntwo"), ("body", 0, "three")]),
    ("- a\n- **b**\n    - c\n- \n", [("bullets", 0, ["a", "<b>b</b><br/>\nc"])]),
    ("1. a\n2. b", [("numbers", 0, ["a", "b"])]),
    ("a\n\n---\n\nb", [("body", 0, "a"), ("spacer", 0, ""), ("rule", 0, ""), ("spacer", 0, ""), ("body", 0, "b")]),
    ("> **quoted** & <x>\n> more", [("quote", 0, "quoted &amp; &lt;x&gt; more")]),
    ("| a | b |\n|---|:-:|\n| 1 | **2** |\n| 3 |", [("table_header", 0, "a | b"), ("table_row", 0, "1 | 2"), ("table_row", 0, "3 | ")]),
    ("    code <x>\n    y", [("body", 0, "code &lt;x&gt;\ny")]),
]


@pytest.mark.parametrize("markdown,want", BLOCKS)
def test_blocks(markdown, want):
    assert shape(markdown) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("a **b *c*** d", "a <b>b c</b> d"),
        ("*i* _j_ snake_case_x", "<i>i</i> <i>j</i> snake_case_x"),
        ("`x < y`", "<font size='9' face='Courier'>x &lt; y</font>"),
        ("[text & more](http://e.com)", "<u>text &amp; more</u>"),
        ("a & b < c > d", "a &amp; b &lt; c &gt; d"),
        (r"\*not\*", "*not*"),
        ("a*** b*** c", "a<b> b</b> c"),
        ("***both*** ***b*a** ***a**b*", "<b>both</b> <b>ba</b> <i>ab</i>"),
        ("**a *b***", "<b>a b</b>"),
        ("a * b * c ** d ** _ e _", "a * b * c ** d ** _ e _"),
        ("*a * b* x*** y", "<i>a * b</i> x*** y"),
        ("__a__ _b c_ x_y_z ___d___", "<b>a</b> <i>b c</i> x_y_z <b>d</b>"),
        ("![alt](x.png)done", "done"),
    ],
)
def test_inline(text, want):
    assert inline(text) == want


def test_md_blocks_and_cover(spark):
    df = spark.createDataFrame([("1", "# A\n\ntext", datetime(2026, 3, 4, 5, 6)), ("2", None, None)], "audit_id string, markdown_report string, at timestamp")
    got = sorted((x.audit_id, x.seq, x.kind, x.text) for x in md_blocks(df).collect())
    assert got == [("1", 0, "heading", "A"), ("1", 1, "body", "text"), ("2", 0, "body", EMPTY)]
    cover = df.filter("at is not null").select(cover_blocks(F.lit("http://e.com/?a&b"), F.col("at")).alias("c")).first().c
    assert [b.text for b in cover] == ["SEO Audit Report", "http://e.com/?a&amp;b", "Generated: 04 March 2026 at 05:06 UTC", ""]


def test_reports_round_trip(spark, tmp_path):
    rows = [(f"id{i}", f"https://e{i}.com", f"# é {i}", "2026-01-02T03:04:05+00:00") for i in range(20)]
    df = spark.createDataFrame(rows, REPORT)
    write_reports(df, str(tmp_path / "r"))
    reports = read_reports(spark, str(tmp_path / "r"))
    found = find_report(reports, "id7")
    assert "PartitionFilters: [isnotnull(id_prefix" in found._jdf.queryExecution().executedPlan().toString()
    assert [(x.url, x.pdf_download_url) for x in found.collect()] == [("https://e7.com", "/api/v1/audits/id7/pdf")]
    assert find_report(reports, "../id7").collect() == []
    write_reports_json(df, str(tmp_path / "j"))
    (tmp_path / "j" / "broken.json").write_text('{"audit_id": "x", broken\n')
    again = read_reports_json(spark, str(tmp_path / "j"))
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_pdf(spark):
    pdf = render_pdf("https://e.com/(x)", "now", "# Title\n\n" + "line of text\n\n" * 200 + "- a\n- b")
    assert pdf.startswith(b"%PDF-1.4") and pdf.rstrip().endswith(b"%%EOF")
    assert b"/Count 1 " not in pdf and b"startxref" in pdf
    rows = [("a", "u", "# x", "2026-01-02T03:04:05+00:00"), ("b", "u", "# x", "no time")]
    got = {x.audit_id: x for x in with_pdf(spark.createDataFrame(rows, REPORT)).collect()}
    assert bytes(got["a"].pdf)[:5] == b"%PDF-" and got["a"].pdf_download_url == "/api/v1/audits/a/pdf"
    assert got["b"].pdf is None and got["b"].pdf_download_url == ""


def drawn(data):
    """The drawing operators of a file's pages, its offsets checked."""
    import re
    import zlib

    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start:].startswith(b"xref\n")
    offsets = [int(x) for x in re.findall(rb"(\d{10}) 00000 n", data[start:])]
    assert all(data[at:].startswith(b"%d 0 obj" % i) for i, at in enumerate(offsets, 1))
    kids = re.search(rb"/Kids \[([^\]]*)\]", data)[1].split(b" 0 R")[:-1]
    assert all(b"/Type /Page " in data[offsets[int(k) - 1] :].split(b"endobj")[0] for k in kids)
    return [zlib.decompress(x) for x in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]


def test_pdf_styles():
    (page,) = drawn(render_pdf("https://e.com/?a&b", "now", "# Big\n\na **b** `c` é €\n\n- x\n- y\n\n1. z\n\n> q\n\n| h | i |\n|---|---|\n| j | k |\n\n---\n"))
    for part in (b"/F2 24 Tf (SEO Audit Report)", b"(https://e.com/?a&b)", b"/F2 18 Tf (Big)", b"/F1 10 Tf (a ) Tj /F2 10 Tf (b) Tj", b"/F4 10 Tf (c)", "é €".encode("cp1252"), b"(\x95 x)", b"(1. z)", b"/F3 10 Tf (q)", b"/F2 9 Tf (h | i)"):
        assert part in page, part
    assert page.count(b" l S") == 2


def test_pdf_lines_fit():
    pages = drawn(render_pdf("u", "now", "word " * 2000 + "\n\n" + "x" * 5000 + "\n\n" + "a(b\\)c\x00 \u4e00"))
    text = b"".join(pages)
    assert len(pages) > 3 and text.count(b"word") == 2000 and text.count(b"x") >= 5000 and b"(a\\(b\\)c  ?)" in text
    for line in pdf._lines("word " * 2000 + "x" * 5000, pdf.STYLES["body"]):
        assert sum(pdf._advance(t.rstrip(), f, 10) for f, t in line) <= 595 - 2 * 56


def test_pdf_files_by_id(spark, tmp_path):
    rows = [(f"id-{i}", "u", "# x", "2026-01-02T03:04:05+00:00" if i else "no time") for i in range(6)]
    write_pdfs(with_pdf(spark.createDataFrame(rows, REPORT)), str(tmp_path / "pdf"))
    found = find_pdf(spark, str(tmp_path / "pdf"), "id-3")
    assert [(x.audit_id, x.name, bytes(x.pdf)[:5]) for x in found.collect()] == [("id-3", "seo-audit-id-3.pdf", b"%PDF-")]
    assert "PartitionFilters: [isnotnull(id_prefix" in found._jdf.queryExecution().executedPlan().toString()
    assert find_pdf(spark, str(tmp_path / "pdf"), "id-0").collect() == find_pdf(spark, str(tmp_path / "pdf"), "../id-3").collect() == []


def test_missing_key(spark):
    texts = spark.createDataFrame([("https://a.com", "## text"), ("https://b.com", "## text")], "base_url string, evidence_text string")
    asked = lambda system, message, evidence: "# report"
    bare, keyed = Settings(), Settings(llm_api_key="k")
    status = lambda settings, provider: [(x.http_status, x.detail) for x in results(with_pdf(with_reports(texts, provider=provider, settings=settings))).collect()]
    assert status(bare, asked) == [(500, MISSING_KEY)] * 2
    assert status(keyed, asked) == status(bare, template_report) == status(None, asked) == [(202, None)] * 2


def test_guidance(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="ai_guidelines"):
        read_guidance(tmp_path)
    for name, (place, _) in FILES.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(f"{name} {{{{website_url}}}}\n", encoding="utf-8")
    (tmp_path / "other.md").write_text("elsewhere", encoding="utf-8")
    assert read_guidance(tmp_path, {"seo_skill": "other.md"}).seo_skill == "elsewhere"
    g = read_guidance(tmp_path)
    prompt = g.system_prompt("https://e.com")
    assert prompt.startswith("## AI Report Guidelines\n\nai_guidelines {{website_url}}\n\n\n---\n\n## SEO Audit Methodology (Skill)\n\n")
    assert prompt.endswith("## Audit Prompt\n\naudit_prompt https://e.com\n")
    assert spark.range(1).select(g.system_prompt_column(F.lit("https://e.com"))).first()[0] == prompt


def test_reports_keep_errors(spark):
    pages = spark.createDataFrame([(1, "https://a.com", "<title>a</title>"), (2, "https://b.com/", "x"), (3, "nope", "x")], "page_id long, url string, html string")
    texts = with_evidence_text(captured_evidence(pages))

    def provider(system, message, evidence):
        if "https://b.com" in evidence:
            raise RuntimeError("no answer")
        return "# ok" if "Please generate a complete" in message else ""

    got = {x.url: x for x in with_reports(texts, provider=provider).collect()}
    assert set(got) == {"https://a.com", "https://b.com"}
    assert (got["https://a.com"].markdown_report, got["https://a.com"].report_error) == ("# ok", None)
    assert (got["https://b.com"].markdown_report, got["https://b.com"].report_error) == (None, "no answer")
    one, two = ({x.audit_id for x in with_reports(texts.repartition(n)).collect()} for n in (1, 3))
    assert one == two and all(len(i) == 64 for i in one)


def test_requests_and_fetch(spark, tmp_path):
    audits = spark.createDataFrame([("a", "https://e.com/x?y"), ("b", "http://f.com")], "audit_id string, url string")

    def get(url, timeout, redirects):
        body = {"https://e.com/robots.txt": "Sitemap: https://e.com/sitemap.xml/\nSitemap: https://e.com/2.xml\nSitemap: https://e.com/1.xml"}.get(url, "")
        status = 0 if "f.com" in url else 200
        return {"final_url": url, "status_code": status, "content": body, "is_success": status == 200, "is_fetched": True, "error_message": "" if status else f"timed out after {timeout}"}

    requests = planned_requests(audits)
    assert {x.url for x in requests.collect()} == {"https://e.com/x?y", "https://e.com/robots.txt", "https://e.com/sitemap.xml", "http://f.com", "http://f.com/robots.txt", "http://f.com/sitemap.xml"}
    got = fetch(requests, read_settings(), get)
    more = further_sitemaps(got).orderBy("seq").collect()
    assert [(x.audit_id, x.seq, x.url, x.label) for x in more] == [("a", 3, "https://e.com/2.xml", "sitemap:https://e.com/2.xml"), ("a", 4, "https://e.com/1.xml", "sitemap:https://e.com/1.xml")]
    assert {(x.audit_id, x.n_resources, x.n_retrieved) for x in fetch_summary(got).collect()} == {("a", 3, 3), ("b", 3, 0)}


def test_requests_of_a_task_run_together(spark):
    requests = spark.createDataFrame([("a", i, "extra", f"https://e.com/{i}", "x") for i in range(32)], "audit_id string, seq int, kind string, url string, label string").coalesce(1)

    def get(url, timeout, redirects):
        import threading
        import time

        time.sleep(0.2)
        return {"final_url": url, "status_code": 200, "content": str(threading.active_count()), "is_success": True, "is_fetched": True, "error_message": ""}

    got = fetch(requests, read_settings(), get, at_once=8).collect()
    assert all(x.final_url == x.url for x in got) and len(got) == 32
    assert max(int(x.content) for x in got) >= 8


def test_http_get_records_failures():
    from siftwell.sources.captures import http_get

    got = http_get("http://127.0.0.1:9/none", 1, 2)
    assert got["is_fetched"] and not got["is_success"] and got["status_code"] == 0 and got["error_message"]
    assert http_get("http://[bad", 1, 2)["error_message"]


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("FETCH_TIMEOUT_SECONDS=7\n# c\nUNKNOWN=1\nDEBUG=true\nREPORTS_DIR='x y'\n")
    monkeypatch.setenv("fetch_max_redirects", "2")
    s = read_settings(tmp_path / ".env")
    assert (s.fetch_timeout_seconds, s.fetch_max_redirects, s.debug, s.reports_dir) == (7, 2, True, "x y")


def test_scoring(spark):
    scores = [100.0, 95.0, 94.9, 90.0, 80.0, 70.0, 60.0, 59.9, 0.0]
    df = spark.createDataFrame([(s,) for s in scores] + [(None,)], "s double")
    got = [tuple(x) for x in df.select(scoring.grade(F.col("s")), scoring.status_band(F.col("s"))).collect()]
    assert [g for g, _ in got] == ["A+", "A+", "A", "A", "B", "C", "D", "F", "F", None]
    assert [b for _, b in got][3:] == ["Excellent", "Good", "Needs Improvement", "Poor", "Critical", "Critical", None]
    assert sum(scoring.CATEGORY_WEIGHTS.values()) == 100
    rows = [("a", c, 100.0 if c == "Technical SEO" else 50.0) for c in scoring.CATEGORY_WEIGHTS] + [("a", "Other", 100.0)]
    assert scoring.overall_score(spark.createDataFrame(rows, "k string, c string, s double"), "k", "c", "s").first().overall_score == 70.0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"https://e{i}.com/", f"<title>t{i}</title><h1>h</h1>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = write_evidence(evidence_stream(page_stream(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    batch = with_evidence_text(captured_evidence(df)).select("audit_id", "evidence_text").collect()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("audit_id", "evidence_text").collect()) == sorted(batch)


def test_whole_chain(spark, tmp_path):
    from siftwell.plans.audit import audit_sites

    def get(url, timeout, redirects):
        body = {"https://e.com/robots.txt": "Sitemap: https://e.com/2.xml", "https://e.com": "<title>e</title>", "https://e.com/2.xml": "<loc>"}.get(url, "")
        status = 200 if body else 404
        return {"final_url": url, "status_code": status, "content": body, "is_success": status == 200, "is_fetched": True, "error_message": ""}

    urls = spark.createDataFrame([("e.com",), (" https://E.com/ ",), ("f.com",), ("nodots",)], "url string")
    got = audit_sites(urls, str(tmp_path / "run"), read_settings(), get, snapshot="1")
    assert [x.http_error for x in got["rejects"].collect()] == [400]
    assert got["resources"].count() == 7
    e = {x.base_url: x for x in got["evidence"].collect()}
    assert e["https://e.com"].page_title == "e" and [s.url_count for s in e["https://e.com"].sitemaps] == [0, 1] and e["https://f.com"].http_status == 404
    r = got["results"].collect()
    assert {x.http_status for x in r} == {202} and len(r) == 2
    assert all(x.markdown_report.startswith("# SEO Audit Report") and x.pdf_download_url == f"/api/v1/audits/{x.audit_id}/pdf" for x in r)


def test_top_findings(spark):
    rows = [("a", s, i) for i, s in enumerate(["Low", "Critical", "High", "Critical", "Medium", "Information", None])]
    got = scoring.top_findings(spark.createDataFrame(rows, "k string, severity string, i int"), "k", ["i"], 3).orderBy("rank").collect()
    assert [(x.severity, x.i) for x in got] == [("Critical", 1), ("Critical", 3), ("High", 2)]


def test_a_getter_that_raises_is_a_result(spark, tmp_path):
    from siftwell.plans.audit import audit_sites

    def get(url, timeout, redirects):
        if url == "https://e.com" or url == "https://f.com/robots.txt":
            raise RuntimeError("no route")
        return {"final_url": url, "status_code": 200, "content": "", "is_success": True, "is_fetched": True, "error_message": ""}

    got = audit_sites(spark.createDataFrame([("e.com",), ("f.com",)], "url string"), str(tmp_path / "run"), read_settings(), get)
    results = {x.url: (x.http_status, x.detail) for x in got["results"].collect()}
    assert results == {"https://e.com": (502, "Could not fetch the website: no route. Please check the URL and try again."), "https://f.com": (202, None)}
    assert [(x.base_url, x.robots_txt) for x in got["evidence"].collect()] == [("https://f.com", None)]

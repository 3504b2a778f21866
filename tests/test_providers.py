import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siftwell.config import Settings
from siftwell.plans.audit import MISSING_KEY, with_reports
from siftwell.sources.reports import lookups


class _Model(BaseHTTPRequestHandler):
    def do_POST(self):  # noqa: N802
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        site = asked["message"].split("audit report for: ")[1].split("\n")[0]
        status = 500 if "broken" in site else 200
        body = {"text": f"# {asked['model']} of {site} é, {self.headers['Authorization']}"} if "empty" not in site else {"text": None}
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    s = HTTPServer(("127.0.0.1", 0), _Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/"
    s.shutdown()


def texts(spark):
    return spark.createDataFrame([(u, "e") for u in ("https://a.com", "https://empty.com", "https://broken.com")], "base_url string, evidence_text string")


def test_model_of_the_settings_is_asked(spark, server):
    got = {x.url: (x.markdown_report, x.report_error) for x in with_reports(texts(spark), settings=Settings(llm_api_key="k", llm_model="m1", llm_url=server)).collect()}
    assert got["https://a.com"] == ("# m1 of https://a.com é, Bearer k", None)
    assert got["https://empty.com"] == (None, "the provider returned no text") and "500" in got["https://broken.com"][1]


def test_model_without_key_or_address(spark, server):
    assert {x.report_error for x in with_reports(texts(spark), settings=Settings(llm_model="m1", llm_url=server)).collect()} == {MISSING_KEY}
    with pytest.raises(ValueError, match="LLM_URL"):
        with_reports(texts(spark), settings=Settings(llm_api_key="k", llm_model="m1"))
    assert with_reports(texts(spark), settings=Settings()).filter("report_error is null").count() == 3


def test_lookups(spark):
    reports = spark.createDataFrame([("a", "u", "r"), ("b", "v", "s")], "audit_id string, url string, markdown_report string")
    wanted = spark.createDataFrame([("a",), ("b",), ("../x",), (None,)], "audit_id string")
    got = {x.audit_id: x for x in lookups(reports, wanted, reports.filter("audit_id = 'a'")).collect()}
    assert (got["a"].http_status, got["a"].markdown_report, got["a"].pdf_download_url, got["a"].detail, got["a"].pdf_status) == (200, "r", "/api/v1/audits/a/pdf", None, 200)
    assert (got["b"].http_status, got["b"].pdf_download_url, got["b"].pdf_status) == (200, "/api/v1/audits/b/pdf", 404)
    assert (got["../x"].http_status, got["../x"].detail, got["../x"].pdf_download_url) == (404, "Audit not found: ../x. Run a new audit to generate a report.", None) and got[None].http_status == 404
    assert lookups(reports.limit(0), wanted).filter("http_status = 404").count() == 4


def test_lookups_answer_once(spark):
    """Two audits of one URL have one id: each row asked for has one answer, its own where a further column tells them apart."""
    rows = spark.createDataFrame([("a", "u", "r", 1), ("a", "u", "r", 2), ("a", "u", "r", 3), ("b", "v", "s", 4)], "audit_id string, url string, markdown_report string, page_id int")
    made, pdfs = rows.filter("page_id <> 2"), rows.filter("page_id = 1 or page_id = 4")
    assert sorted((x.audit_id, x.http_status, x.pdf_status) for x in lookups(made, rows, made).collect()) == [("a", 200, 200)] * 3 + [("b", 200, 200)]
    got = {x.page_id: (x.http_status, x.pdf_status) for x in lookups(made, rows, pdfs, also=("page_id",)).collect()}
    assert got == {1: (200, 200), 2: (404, 404), 3: (200, 404), 4: (200, 200)}

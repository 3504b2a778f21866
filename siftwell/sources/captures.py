"""Captured responses, planned requests and live fetches, all in the ``RESOURCE`` schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.robots import sitemaps_to_fetch
from ..functions.urls import site_root
from ..schemas import RESOURCE

#: What is sent with every request.
HEADERS = {
    "User-Agent": "siftwell/0.1.0 (page audits)",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.5",
}
_FETCHED = "final_url string, status_code int, content string, is_success boolean, is_fetched boolean, error_message string"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of resources; columns and filters are pushed to the scan."""
    return spark.read.schema(RESOURCE).parquet(path)


def captured_pages(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Captured pages as successful homepage fetches: the audit's key, URL as requested, and body."""
    return pages.select(F.col(key).cast("string").alias("audit_id"), F.col(url).alias("url"), F.col(html).alias("content"))


def planned_requests(audits: DataFrame) -> DataFrame:
    """Three requests for each ``(audit_id, url)``: the page, robots.txt and sitemap.xml of its site."""
    root = site_root(F.col("url"))
    row = lambda seq, kind, url, label: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), url.alias("url"), F.lit(label).alias("label"))
    three = F.array(row(0, "homepage", F.col("url"), "homepage"), row(1, "robots", F.concat(root, F.lit("/robots.txt")), "robots.txt"), row(2, "sitemap", F.concat(root, F.lit("/sitemap.xml")), "sitemap.xml"))
    return audits.select("audit_id", F.explode(three).alias("r")).select("audit_id", "r.*")


def further_sitemaps(resources: DataFrame) -> DataFrame:
    """Requests for the sitemaps that fetched robots.txt files name, but for the standard one, in order."""
    robots = resources.filter("kind = 'robots' and is_success and content <> ''")
    standard = F.rtrim(F.concat(site_root(F.col("url")), F.lit("/sitemap.xml")), F.lit("/"))
    found = F.filter(sitemaps_to_fetch(F.col("content")), lambda u: F.rtrim(u, F.lit("/")) != standard)
    return robots.select("audit_id", F.posexplode(found).alias("i", "url")).select("audit_id", (F.col("i") + 3).alias("seq"), F.lit("extra").alias("kind"), "url", F.concat(F.lit("sitemap:"), F.col("url")).alias("label"))


def http_get(url: str, timeout: int, max_redirects: int) -> dict:
    """One request; every failure is a record, none is raised."""
    import http.client
    import socket
    import urllib.error
    import urllib.request

    class Limited(urllib.request.HTTPRedirectHandler):
        max_redirections = max_redirects

    def record(final="", status=0, content="", error=""):
        return {"final_url": final, "status_code": status, "content": content, "is_success": 200 <= status < 300, "is_fetched": True, "error_message": error}

    def body(response) -> str:
        charset = response.headers.get_content_charset() or "utf-8"
        try:
            return response.read().decode(charset, "replace")
        except LookupError:
            return ""

    try:
        with urllib.request.build_opener(Limited).open(urllib.request.Request(url, headers=HEADERS), timeout=timeout) as r:
            return record(r.geturl(), r.status, body(r))
    except urllib.error.HTTPError as e:
        if "redirect" in str(e.reason).lower() and "infinite loop" in str(e.reason).lower():
            return record(error="Too many redirects. The page could not be reached.")
        return record(e.geturl() or url, e.code, body(e))
    except (TimeoutError, socket.timeout):
        return record(error=f"Request timed out after {timeout} seconds. The server did not respond in time.")
    except urllib.error.URLError as e:
        if isinstance(e.reason, TimeoutError):
            return record(error=f"Request timed out after {timeout} seconds. The server did not respond in time.")
        return record(error=f"Could not connect to the server: {e.reason}")
    except (OSError, http.client.HTTPException, ValueError) as e:
        return record(error=f"Could not connect to the server: {e}")


Getter = Callable[[str, int, int], dict]


def attempted(get: Getter, url: str, timeout: int, max_redirects: int) -> dict:
    """The getter's record; one that isn't fetched, with the error's text, where it raised."""
    try:
        return get(url, timeout, max_redirects)
    except Exception as e:  # noqa: BLE001  an unforeseen error is that request's, not the task's
        return {"final_url": "", "status_code": 0, "content": "", "is_success": False, "is_fetched": False, "error_message": str(e)}


#: Requests that one task has open at a time.
AT_ONCE = 16


def fetch(requests: DataFrame, settings: Settings, get: Getter = http_get, at_once: int = AT_ONCE) -> DataFrame:
    """Runs the requests on the executors, ``at_once`` of a task together.  A side effect: write the result before using it twice.

    A request whose getter raised has ``is_fetched`` false and the error's text.
    """
    timeout, redirects = settings.fetch_timeout_seconds, settings.fetch_max_redirects
    names = [f.split()[0] for f in _FETCHED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            for b in batches:
                got = pd.DataFrame(list(pool.map(lambda u: attempted(get, u, timeout, redirects), b["url"])), columns=names)
                yield pd.concat([b.reset_index(drop=True), got], axis=1)

    return requests.select("audit_id", "seq", "kind", "url", "label").mapInPandas(run, f"audit_id string, seq int, kind string, url string, label string, {_FETCHED}").select(*[f.split()[0] for f in RESOURCE.split(", ")])


def fetch_summary(resources: DataFrame) -> DataFrame:
    """Resources asked for and retrieved, per audit."""
    return resources.groupBy("audit_id").agg(F.count("*").alias("n_resources"), F.count_if("is_success").alias("n_retrieved"))

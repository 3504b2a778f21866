import pytest
from pyspark.sql import functions as F

from siftwell.functions.urls import MESSAGES, normal_url, normalize_url
from siftwell.plans.audit import accepted, checked_urls, rejected

LONG = "x" * 64
CASES = {
    "www.example.com": "https://www.example.com",
    "  example.com  ": "https://example.com",
    " \texample.com\n": "https://example.com",
    "HTTPS://EXAMPLE.COM/Path/?Q=1#f": "https://example.com/Path/?Q=1",
    "https://example.com/": "https://example.com",
    "https://example.com/?": "https://example.com",
    "https://example.com/?a=1": "https://example.com?a=1",
    "https://example.com/about/": "https://example.com/about/",
    "https://example.com/a;p?q=1": "https://example.com/a;p?q=1",
    "example.com:8080": "https://example.com:8080",
    "https://example.com:abc": "https://example.com:abc",
    "a.bc": "https://a.bc",
    "1.2.3.4": "https://1.2.3.4",
    "a.-b.com": "https://a.-b.com",
    "exa\tmple.com": "https://example.com",
    "http://sub.example.com/x#y#z": "http://sub.example.com/x",
    "example.com/a?b?c": "https://example.com/a?b?c",
    "": "empty",
    "   ": "empty",
    None: "empty",
    "abc": "too_short",
    "mailto:u@e.com": "scheme_not_allowed",
    "javascript:alert(1)": "scheme_not_allowed",
    "localhost:8000": "scheme_not_allowed",
    "ftp://example.com": "scheme_not_allowed",
    "file:///etc/hosts": "scheme_not_allowed",
    "example.com?u=http://x": "scheme_not_allowed",
    "https://": "no_domain",
    "//example.com": "invalid_domain",
    "example": "invalid_domain",
    "localhost": "invalid_domain",
    "example..com": "invalid_domain",
    "example.com.": "invalid_domain",
    f"{LONG}.com": "invalid_domain",
    "https://user:pw@example.com": "invalid_domain",
    "http:example.com": "invalid_domain",
    "https://[::1]": "invalid_domain",
    "http://[bad.com": "invalid_domain",
    "user@example.com": "invalid_domain",
    "https://example .com": "invalid_domain",
    "héllo.com": "invalid_domain",
}


@pytest.fixture(scope="module")
def results(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url string").select("url", normalize_url(F.col("url")).alias("r"))
    return {x.url: x.r for x in df.collect()}


@pytest.mark.parametrize("url", CASES)
def test_vectors(results, url):
    r, want = results[url], CASES[url]
    if url == "//example.com":  # gets "https:////example.com": no authority
        want = "no_domain"
    if want.startswith("http"):
        assert (r.is_valid, r.normalized_url, r.error_code, r.error_message) == (True, want, "", "")
    else:
        assert (r.is_valid, r.normalized_url, r.error_code) == (False, "", want)
        assert r.error_message


def test_messages(results):
    assert results["mailto:u@e.com"].error_message == MESSAGES["bare_scheme"].format("mailto")
    assert results["example.com?u=http://x"].error_message == MESSAGES["scheme"].format("")
    assert results[f"{LONG}.com"].error_message == MESSAGES["long_label"].format(f"{LONG}.com")
    assert results["example.com."].error_message == MESSAGES["empty_label"].format("example.com.")
    assert results["http:example.com"].error_message == MESSAGES["no_dot"].format("http")
    assert results["abc"].error_message == MESSAGES["too_short"].format("abc")


def test_rejects(spark):
    df = checked_urls(spark.createDataFrame([("example.com",), ("ab",), ("x" * 2049 + ".com",), ("nodots",), (None,)], "url string"))
    assert [x.normalized_url for x in accepted(df).collect()] == ["https://example.com"]
    assert {(x.url or "")[:6]: x.http_error for x in rejected(df).collect()} == {"ab": 422, "xxxxxx": 422, "nodots": 400, "": 422}


def test_normal_as_they_stand(spark):
    """What ``normal_url`` takes as it stands is what the whole normalisation makes of it."""
    hosts = ["e.com", "E.com", "a-b.c9.org", "-a.com", "a.com-", "a..com", "e", "x" * 63 + ".com", "x" * 64 + ".com", "e.com:80", "e.com:", "e.com:x", "u@e.com", "é.com", "e.com.", "1.2"]
    rests = ["", "/", "//", "/p", "/P/q;x=1", "/?", "?", "?q", "/?q=1", "/p?", "/p?q=a?b", "/p#", "/p#f", "/p q", " ", "\t", "/é", "/a\tb", "/p?q=\n", "/:", "?a/b", "/%41", "\\x"]
    urls = [f"{s}{h}{r}" for s in ("http://", "https://", "HTTP://", "ftp://", "", "//") for h in hosts for r in rests] + [None, "", "http://", "https://"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", normal_url(F.col("u")).alias("n"), normalize_url(F.col("u")).alias("w")).collect()
    assert all(x.n == (x.w.normalized_url if x.w.is_valid else None) for x in rows) and sum(x.n is not None and x.n == x.u for x in rows) > 100


def test_a_fragment_is_left_out_before_the_whole_normalisation(spark):
    urls = [f"{u}#{f}" for u in ("https://e.com", "https://e.com/", "http://e.com:80/p", "https://e.com/p?q=1", "HTTPS://E.com/p", "e.com/p", "https://e", "", " https://e.com/p", "https://e.com/p ") for f in ("", "f", "a#b", " ", "\t\n", "?x/y", "https://x.y", "é", "\x00")]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(normal_url(F.col("u")).alias("n"), normalize_url(F.col("u")).alias("w")).collect()
    assert all(x.n == (x.w.normalized_url if x.w.is_valid else None) for x in rows) and all("#" not in (x.n or "") for x in rows)

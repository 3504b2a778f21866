"""Counters that arrive with writes, snapshots compared, audits before."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwell.plans.audit import captured_evidence, checked_urls
from siftwell.plans.counters import RunCounters, StreamCounters, fetch_metrics, reject_metrics
from siftwell.plans.history import audit_before, changes
from siftwell.streaming.evidence_stream import evidence_stream, page_stream, write_evidence


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_counters_come_with_the_write(spark, tmp_path):
    urls = ["", "abc", "ftp://e.com", "https://", "a..b.com", "e.com", "x.org", "ab" * 1100 + ".com", None]
    checked = checked_urls(spark.createDataFrame([(u,) for u in urls], "url string"))
    counters = RunCounters()
    watched = counters.watch("requests", checked, reject_metrics())
    plain = jobs(spark, lambda: checked.write.parquet(str(tmp_path / "plain")))
    assert jobs(spark, lambda: watched.write.parquet(str(tmp_path / "watched"))) == plain
    assert jobs(spark, counters.get) == 0
    got = counters.get()
    assert got["requests", "requests"] == 9 and got["requests", "rejected_empty"] == 2
    code = F.when(F.col("http_error").isNotNull(), F.when(F.col("is_valid"), "length").otherwise(F.col("error_code")))
    want = {r.c: r["count"] for r in checked.select(code.alias("c")).filter("c is not null").groupBy("c").count().collect()}
    assert {k[1].removeprefix("rejected_"): n for k, n in got.items() if k[1] != "requests" and n} == want
    assert counters.table(spark).count() == len(got)


def test_fetch_counters_with_nulls_and_none(spark, tmp_path):
    counters = RunCounters()
    schema = "kind string, is_success boolean, is_fetched boolean, content string"
    for name, rows in (("some", [("homepage", True, True, "ab"), ("robots", None, None, None), ("extra", False, False, "c"), (None, True, True, "")]), ("none", [])):
        counters.watch(name, spark.createDataFrame(rows, schema), fetch_metrics()).write.parquet(str(tmp_path / name))
    got = counters.get()
    some = {m: n for (name, m), n in got.items() if name == "some" and n}
    assert some == {"asked": 4, "retrieved": 2, "raised": 2, "bytes": 3, "asked_homepage": 1, "retrieved_homepage": 1, "asked_robots": 1, "asked_extra": 1}
    assert not any(n for (name, _), n in got.items() if name == "none")


def test_stream_counters(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, f"https://e{i}.com", "<p>x" if i else None)], "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters = StreamCounters("evidence")
    spark.streams.addListener(counters)
    try:
        q = write_evidence(evidence_stream(page_stream(spark, str(tmp_path / "in"), 1), "evidence"), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if counters.batches == 3:
                break
            q.awaitTermination(0.1) if q.isActive else __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(counters)
    assert counters.batches == 3 and dict(counters.total) == {"pages": 3, "with_html": 2, "bytes": 8}


OLD = [("a", "t", ["x"], 1), ("b", None, None, 2), ("c", "t", [], 3), (None, "n", ["y"], None), ("gone", "g", [], 5), ("same", None, ["p", None], None)]
NEW = [("a", "T", ["x", "z"], 1), ("b", None, [], 2), ("c", "t", [], None), (None, "m", ["y"], None), ("new", "g", [], 5), ("same", None, ["p", None], None)]


def test_changes(spark):
    schema = "base_url string, title string, tags array<string>, n int"
    got = changes(spark.createDataFrame(OLD, schema), spark.createDataFrame(NEW, schema), fields=("title", "tags", "n"))
    assert got.columns == ["base_url", "change", "field", "old_value", "new_value"]
    assert {tuple(r) for r in got.collect()} == {
        ("a", "changed", "title", "t", "T"), ("a", "changed", "tags", '["x"]', '["x","z"]'), ("b", "changed", "tags", None, "[]"), ("c", "changed", "n", "3", None),
        (None, "changed", "title", "n", "m"), ("gone", "removed", None, None, None), ("new", "added", None, None, None),
    }
    none = spark.createDataFrame([], schema)
    assert changes(none, none, fields=("n",)).collect() == [] and changes(none, spark.createDataFrame(NEW, schema), fields=("n",)).count() == len(NEW)


def test_changes_of_whole_evidence(spark):
    page = lambda t: captured_evidence(spark.createDataFrame([(1, "https://e.com", f"<title>{t}</title><a href='/x'>")], "page_id long, url string, html string"))
    assert changes(page("a"), page("a")).collect() == []
    assert [tuple(r) for r in changes(page("a"), page("b")).collect()] == [("https://e.com", "changed", "page_title", "a", "b")]


def test_changes_shuffle_once(spark):
    df = spark.createDataFrame(OLD, "base_url string, title string, tags array<string>, n int")
    plan = changes(df, df, fields=("title",))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("span", ["day", "month"])
def test_audit_before(spark, span):
    r, start = random.Random(3), datetime(2024, 1, 30)
    rows = [(i, r.choice(["u", "v", None]), start + timedelta(hours=r.randint(0, 90)) if r.random() < 0.95 else None, {"k": 1}) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, url string, at timestamp, span map<string,int>")
    got = audit_before(df, df, time="at", keep=("id",), span=span).collect()
    assert len(got) == len(rows)
    for x in got:
        earlier = [(t, i) for i, u, t, _ in rows if u == x.url and u and t and x["at"] and t < x["at"]]
        assert (x.before_at, x.before_id) == (max(earlier) if earlier else (None, None)) and x.span == {"k": 1}
    assert audit_before(df.limit(0), df, time="at", keep=("id",)).filter("before_id is not null").count() == 0

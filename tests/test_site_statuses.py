from siftwell.operators.findings import CHECKS
from siftwell.plans.site_checks import DECIDED, site_check_statuses
from siftwell.schemas import ROBOTS


def test_statuses(spark):
    words = "word " * 300
    page = lambda n, status=200, final=None, html="", fetched=True: (f"https://e.com/{n}", status, fetched, final, html)
    rows = [
        page("", html=f"{words}<a href=/a>a<a href=/dead>d<a href=/nowhere>n<script type='application/ld+json'>{{\"@type\":\"Product\",\"name\":\"x\"}}</script>"),
        page("a", html="<meta name=robots content='nofollow, NOINDEX'><a href=/>h<a href=/hop1>h<script type='application/ld+json'>{</script>"),
        page("dead", 404, html=words),
        page("hop1", final="https://e.com/hop2", html=words),
        page("hop2", final="https://e.com/a"),
        page("l1", final="https://e.com/l2"), page("l2", final="https://e.com/l1"),
        page("copy", html=f"<link rel=canonical href=https://e.com/a>{words}"),
        page("private", html="<script type='application/ld+json'>{\"@type\":\"Product\"}</script>"),
        page("lost", None, fetched=False, html=None), page("lost#again", None, fetched=None),
    ]
    robots = spark.createDataFrame([("https://e.com/robots.txt", (True, 200, ["/private"], [], [], False))], f"url string, rules {ROBOTS}")
    df = spark.createDataFrame([*rows, (None, 200, True, None, ""), ("no url", 200, True, None, "")], "url string, status_code int, is_fetched boolean, final_url string, html string")
    got = {(x.page.removeprefix("https://e.com"), x.check): x.status for x in site_check_statuses(df, robots, hot_rows=2).collect()}
    checks = [c for names in DECIDED.values() for c in names]
    assert len(got) == 10 * len(checks) and all(c in CHECKS[cat] for cat, names in DECIDED.items() for c in names)
    by = lambda check, status: {p for (p, c), s in got.items() if c == check and s == status}
    everything = {p for p, _ in got}
    assert by("Redirects", "Fail") == {"/hop1", "/l1", "/l2"} and by("Redirects", "Pass") == everything - {"/hop1", "/l1", "/l2"}
    assert by("Duplicate URLs", "Fail") == {"/hop1", "/hop2", "/l2", "/copy"} and by("Crawlability", "Fail") == {"/private"}
    assert by("Meta Robots", "Fail") == {"/a"} and by("Meta Robots", None) == {"/dead", "/lost"}
    assert by("Indexability", "Pass") == {"", "/l1"}
    assert by("Broken Links", "Fail") == {""} and by("Broken Links", None) == {"/dead", "/lost"}
    assert by("Structured Data", "Pass") == {""} and by("Structured Data", "Fail") == {"/a", "/private"}
    assert by("Internal Linking", "Pass") == {"", "/a", "/dead", "/hop1"}
    assert by("Thin Content", "Pass") == {"", "/hop1", "/copy"} and by("Thin Content", None) == {"/dead", "/lost"}
    assert site_check_statuses(df.limit(0), robots).collect() == []

import random
import time
from collections import Counter

import pytest

from siftwell.llm.html_extract import main_text, measure, parse, text_of

NONE = frozenset()


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<article><h1>A &amp; B</h1><p>one\n two<p>three<ul><li>x<li>y</ul></article>", "A & B\n\none two\n\nthree\n\nx\n\ny"),
        ("<nav>menu</nav><main><p>t&#233;xt&nbsp;x</p></main><footer>f</footer>", "téxt x"),
        ("<body><div class='ad'>buy</div><div class=\"post-comments\">c</div><div class=content><p>t</p></div></body>", "t"),
        ("<article><script>var a='</p>';</script><style>p{}</style><p>a<!-- c --><b>b</b>c</p><form>f<input></form></article>", "abc"),
        ("<article><p>a<br>b</p><p>cut <b>off", "a b\n\ncut off"),
        ("<article><p>a</p><div", "a"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<article><p>x</p><aside>s</aside><section id='comments'><p>c</p></section><p>y</p></article>", "x\n\ny"),
        ("<html><head><title>t</title></head><body><p>one</p><p>two</p></body></html>", "one\n\ntwo"),
        ("<article><p>&lt;b&gt; stays</p></article>", "<b> stays"),
        ("<nav><ul><li>menu<article><p>text</p></article>", "text"),
        ("<article><header><h1>The <a href=/x/>title</a></h1><p>by someone</p></header><p>t</p><header><nav>n</nav></header></article>", "The title\n\nt"),
        ("<article><section id='discussion'><p>d</p></section><section id=related-work>r</section><div class=share-prices>s</div><p class='comments-policy'>c</p></article>", "d\n\nr\n\ns\n\nc"),
        ("<article><p>t</p><div class='share-buttons'>s</div><div class='post-comments'>c</div><div class='ad'>a</div><p class=advert>b</p><div id=cookie-notice>k</div></article>", "t"),
        ("<article><p title=it's>one<p title='it>s'>two</p><p title=\"a>three</p></article>", "one\n\ntwo\n\nthree"),
        ("<html><head><title>t</title><body><p>no end of the head</p>", "no end of the head"),
        ("<table><tr><td>a<td>b<tr><td><table><tr><td>in</table>c</table>", "a\n\nb\n\nin\n\nc"),
        ("<script>never closed <p>x</p>", ""),
        ("x <", "x <"),
        ("<article><p>a</p><svg><path><p>b</p></article>", "a\n\nb"),
        ("<article><p>a <svg><text>no<svg>no</svg>no</svg>b<p>c</article>", "a b\n\nc"),
        ("<article><p>a</p><iframe src=x><p>b</p></article>", "a\n\nb"),
        ("<article><p>a</p><iframe src=x>no <p>no</iframe><p>b</p></article>", "a\n\nb"),
        ("<article><template><p>no<template>no</template>no</p></template><p>a</p></article>", "a"),
        ("<article><div><template><p>no</div><p>a</p></article>", "a"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be.</p><math><mi>y<p>z</article>", "Let x=2 be.\n\ny\n\nz"),
        ("<article><noscript><p>plain</p></noscript><p>a</p></article>", "plain\n\na"),
        ("<article><svg><foreignObject><p>no</p></foreignObject><p>a</p></svg></article>", "a"),
        ("<article><p>t</p><article class=comment><p>c</p></article><div class=comment>c</div><div class='reply'>r</div><ol class=commentlist><li>c</ol><li class=comment>x</li></article>", "t"),
        ("<main><article class=post><p>t</p></article><article class='user-comment'>c</article><article id=comment-12>d</article></main>", "t"),
        ("<article class='comment-piece'><p>a column</p></article>", "a column"),
        ("<body><h2 id=related-work>r</h2><p id=discussion>d</p><section id=responses>s</section><div class=menu-recipes>m</div><div class=main-menu>x</div><div id=footer>f</div></body>", "r\n\nd\n\ns\n\nm"),
        ("<article><p class=share>Each share rose.</p><div class=share>x</div></article>", "Each share rose."),
        ("<body><h1>Title <i>one</i></h1><p>no</p><article><p>t</p></article><h1>later</h1></body>", "Title one\n\nt"),
        ("<body><header><h1>Site</h1></header><h1>Site</h1><article><h1>Own</h1><p>t</p></article></body>", "Own\n\nt"),
        ("<article><nav>" + "<div>" * 1000 + "menu" + "</div>" * 1000 + "</nav>text</article>", "text"),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ],
)
def test_text(page, want):
    assert text_of(page, NONE) == want


@pytest.mark.parametrize("part", ["<i title=it's ", "<b>", "<p><b>", "</x>", "<td>", "<a b='", "<!--", "<![", "<script ", "</script ", "<li>", "< ", "<a/", "&amp", "<article>", "<nav><x>", "<table><td>", "<iframe>", "<svg>", "<svg><p>", "<template>", "<math>", "<svg><foreignObject>", "<h1>"])
def test_hostile_pages_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    for x in (page, "<script>" + page, "<article><x>" + page + "</x>" * 1000):
        start = time.process_time()
        text_of(x, NONE)
        assert time.process_time() - start < 5


def test_templates_are_counted_per_host(spark):
    box = "<div><p>Subscribe now to our letter of news</p></div>"
    rows = [(i, f"https://a.example/{i}", f"<body>{box}<div><p>body text number {i}</p></div></body>", "z") for i in range(8)]
    rows += [(20, "https://b.example/1", f"<body>{box}</body>", "z"), (21, None, None, "z"), (22, "https://a.example/0", rows[0][2], "z")]
    rows += [(30 + i, f"http://c.example:80/{i}", f"<article><p>the same copy of one page</p></article>{box}", "z") for i in range(9)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, slice string")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"body text number {i}" for i in range(8))
    assert got[20] == "Subscribe now to our letter of news"
    assert got[21] == "" and got[22] == got[0]
    assert all(got[30 + i] == "the same copy of one page" for i in range(9))


def test_template_of_a_section_of_a_large_host(spark):
    """A section's box is on a tenth of the host's pages; pages differ, none has an article."""
    rows = [(i, f"https://big.example/s{i % 10}/{i}", f"<body><div><a href=/>Read more in section {i % 10}</a></div><div><p>text of page {i} alone</p></div></body>") for i in range(1000)]
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text of page {i} alone" for i in range(1000)}


@pytest.mark.parametrize("least,share,many", [(2, 0.2, 1000), (3, 0.9, 7), (5, 0.05, 100)])
def test_against_a_plain_count(spark, least, share, many):
    r = random.Random(least)
    boxes = [f"<{t}><a href=/{i}>box {i} {'of words ' * (i % 4)}</a></{t}>" for i, t in enumerate(["div", "section", "ul", "table", "p", "div", "div", "blockquote"] * 3)]

    def page(i):
        parts = [r.choice(boxes[:6] if r.random() < 0.5 else boxes) for _ in range(r.randint(0, 7))] + [f"<div><p>own text {i if r.random() < 0.8 else 0}</p><span>{r.choice('ab')}</div>"]
        r.shuffle(parts)
        cut = r.randint(0, len(parts))
        body = "".join(parts[:cut]) + (f"<article><p>story {i % 9}</p>{parts[0]}</article>" if r.random() < 0.4 else "") + "".join(parts[cut:])
        return body[: r.randint(1, 2 * len(body))]

    rows = [(i, f"https://{r.choice(['a', 'a', 'a', 'b', 'c'])}.example/{i}", page(i)) for i in range(200)]
    on, size = Counter(), Counter()
    for _, url, html in rows:
        host, found = url.split("/")[2], []
        measure(parse(html), found)
        size[host] += 1
        on.update((host, k) for k in set(found))
    keys = {h: {k for (x, k), n in on.items() if x == h and n >= least and n >= min(share * size[h], max(many, size[h] / 1000))} for h in size}
    assert sum(map(len, keys.values())) > 5
    got = {x.page_id: x.text for x in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), least_pages=least, share=share, many_pages=many).collect()}
    assert got == {i: text_of(html, keys[url.split("/")[2]]) for i, url, html in rows}


def test_long_pages_keep_their_text():
    paragraphs = [f"paragraph {i} of a <b>long</b> page" for i in range(60_000)]
    page = "<svg>" * 500 + "<body><nav>" + "<li>menu" * 5000 + "</nav><article>" + "<p>".join(["", *paragraphs]) + "<template>" * 300
    assert text_of(page, NONE) == "\n\n".join(p.replace("<b>", "").replace("</b>", "") for p in paragraphs)


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []

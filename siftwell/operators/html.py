"""One parse per page, in Arrow batches; everything after it is native again.

The parser is lenient: unclosed elements end with the document, a heading or title that is open still ends at the next one
of its kind, and text of scripts, styles and comments yields nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import LINKS, PARSED

_DESCRIPTION = re.compile(r"^description$", re.I)
_CANONICAL = re.compile(r"canonical", re.I)


def _none_if_blank(text: str | None) -> str | None:
    return (text or "").strip() or None


#: Absolute URLs, fragments and paths from the root that joining leaves as they stand, and what a base gives to such a path.
_WHOLE_URL = re.compile(r"https?://[a-zA-Z0-9.\-]+(?::[0-9]+)?/[a-zA-Z0-9_~\-/]*(?:\?[a-zA-Z0-9_~\-/.=&%]+)?(?:#[a-zA-Z0-9_\-]+)?")
_OTHER_SCHEME = re.compile(r"(?:mailto|tel):[a-zA-Z0-9_.@+\-]+")
_FRAGMENT = re.compile(r"#[a-zA-Z0-9_\-]+")
_ROOT_PATH = re.compile(r"/(?!/)[a-zA-Z0-9_~\-/]*(?:\?[a-zA-Z0-9_~\-/.=&%]+)?(?:#[a-zA-Z0-9_\-]+)?")
_ROOT = re.compile(r"(https?://[a-zA-Z0-9.\-]+(?::[0-9]+)?)(?=[/?#]|\Z)")


@lru_cache(maxsize=1 << 14)
def resolve(base: str, href: str) -> str | None:
    """The absolute URL, or None where the parts make no URL."""
    root = _ROOT.match(base)
    if root and (_WHOLE_URL.fullmatch(href) or _OTHER_SCHEME.fullmatch(href)):
        return href
    if _FRAGMENT.fullmatch(href) and _WHOLE_URL.fullmatch(base):
        return base.partition("#")[0] + href
    if root and _ROOT_PATH.fullmatch(href):
        return root[1] + href
    return _joined(base, href)


def _joined(base: str, href: str) -> str | None:
    try:
        out = urljoin(base, href)
        urlsplit(out)
    except ValueError:
        return None
    return out


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.title: list[str] | None = None
        self.first: dict[str, dict] = {}
        self.headings: dict[str, list[list[str]]] = {"h1": [], "h2": []}
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.og: dict[str, str] = {}
        self.open: set[str] = set()
        self.json_ld: list[str] = []
        self.in_json = False

    def handle_starttag(self, tag: str, pairs: list) -> None:
        a: dict[str, str] = {}
        for k, v in pairs:
            a.setdefault(k, v or "")
        self.in_json = tag == "script" and a.get("type", "").split(";")[0].strip().lower() == "application/ld+json"
        if self.in_json:
            self.json_ld.append("")
        if tag == "title":
            if self.title is None:
                self.title = []
                self.open.add(tag)
            else:
                self.open.discard(tag)
        elif tag in self.headings:
            self.headings[tag].append([])
            self.open.add(tag)
        elif tag == "html":
            self.first.setdefault("html", a)
        elif tag == "meta":
            if "name" in a and _DESCRIPTION.search(a["name"]):
                self.first.setdefault("description", a)
            if a.get("name", "").lower() == "robots":
                self.first.setdefault("robots", a)
            if a.get("property", "").lower().startswith("og:"):
                self.og.setdefault(a["property"].lower(), a.get("content", "").strip())
        elif tag == "link" and _CANONICAL.search(a.get("rel", "")):
            self.first.setdefault("canonical", a)
        elif tag == "a" and "href" in a:
            raw = a["href"].strip()
            absolute = resolve(self.base, raw)
            if absolute is not None:
                self.links.append({"raw": raw, "absolute": absolute})
        elif tag == "img" and a.get("src", "").strip():
            src = resolve(self.base, a["src"].strip())
            if src is not None:
                self.images.append({"src": src, "alt": a.get("alt", "").strip(), "has_alt_attribute": "alt" in a})

    def handle_endtag(self, tag: str) -> None:
        self.open.discard(tag)
        self.in_json &= tag != "script"

    def handle_data(self, data: str) -> None:
        if self.in_json:
            self.json_ld[-1] += data
        piece = data.strip()
        if not piece or self.cdata_elem in ("script", "style"):
            return
        if "title" in self.open:
            self.title.append(piece)
        for h in ("h1", "h2"):
            if h in self.open:
                self.headings[h][-1].append(piece)


_PLAIN_NAME = "(?:html|head|body|meta|link|h[1-6]|p|br|hr|div|span|ul|ol|li|dl|dt|dd|table|tr|td|th|img|b|i|em|strong|section|nav|header|footer|main)"
#: Start tags that neither link nor change how what follows is read; and a run of text, such tags, end tags and comments, all well-formed.
_PLAIN = re.compile(rf"<{_PLAIN_NAME}[\s/>]", re.I)
_PLAIN_RUN = re.compile(
    rf"""(?:[^<]*+<(?:{_PLAIN_NAME}(?:\s++[a-z\-:]++(?:=(?:"[^"]*+"|'[^']*+'|[^\s"'<>/=`]++))?+)*+\s*+/?+>|/[a-z][a-z0-9]*+\s*+>|!--(?![\->])(?:[^\-]++|-(?!-))*+-->))*+""",
    re.I | re.A,
)


class _Links(HTMLParser):
    """The links that ``_Page`` finds, and no more: plain tags aren't taken apart, runs of them are passed over, lines aren't counted."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.links: list[tuple[str, str]] = []

    def updatepos(self, i: int, j: int) -> int:
        return j

    def _after(self, end: int) -> int:
        return end if end < 0 or self.cdata_elem else _PLAIN_RUN.match(self.rawdata, end).end()

    def parse_starttag(self, i: int) -> int:
        return self._after(self.check_for_whole_start_tag(i) if _PLAIN.match(self.rawdata, i) else super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._after(super().parse_endtag(i))

    def handle_starttag(self, tag: str, pairs: list) -> None:
        hrefs = [v or "" for k, v in pairs if k == "href"] if tag == "a" else []
        if hrefs:
            raw = hrefs[0].strip()
            absolute = resolve(self.base, raw)
            if absolute is not None:
                self.links.append((raw, absolute))


def parse_page(base: str | None, content: str | None) -> dict:
    """The ``PARSED`` record of one page; of an empty one where there is no content."""
    p = _Page(base or "")
    if content:
        p.feed(content)
        p.close()
    get = lambda what, name: _none_if_blank(p.first.get(what, {}).get(name))
    texts = {h: [t for t in (" ".join(x) for x in found) if t] for h, found in p.headings.items()}
    return {
        "page_title": _none_if_blank("".join(p.title or [])),
        "meta_description": get("description", "content"),
        "canonical_url": get("canonical", "href"),
        "page_language": get("html", "lang"),
        "h1_tags": texts["h1"],
        "h2_tags": texts["h2"],
        "links": p.links,
        "images": p.images,
        "og_tags": p.og,
        "robots_meta": get("robots", "content"),
        "json_ld": p.json_ld,
    }


_TEXTS = pa.list_(pa.string())
#: ``PARSED`` as Arrow has it.
_FORM = pa.struct({
    "page_title": pa.string(), "meta_description": pa.string(), "canonical_url": pa.string(), "page_language": pa.string(), "h1_tags": _TEXTS, "h2_tags": _TEXTS,
    "links": pa.list_(pa.struct({"raw": pa.string(), "absolute": pa.string()})), "images": pa.list_(pa.struct({"src": pa.string(), "alt": pa.string(), "has_alt_attribute": pa.bool_()})),
    "og_tags": pa.map_(pa.string(), pa.string()), "robots_meta": pa.string(), "json_ld": _TEXTS,
})


def _parse_batches(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for base, content in pages:
        rows = [parse_page(b, c) for b, c in zip(base.to_pylist(), content.to_pylist(), strict=True)]
        yield pa.array([r | {"og_tags": list(r["og_tags"].items())} for r in rows], _FORM)


def parsed(base: Column, content: Column) -> Column:
    """The ``PARSED`` struct of a page; one Python evaluation however many of its fields are used.

    It counts as non-deterministic, which it isn't, so that the optimizer never copies it below a filter on its fields; filter
    on other columns first.
    """
    return F.arrow_udf(_parse_batches, PARSED).asNondeterministic()(base, content)


def _link_batches(pages: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for base, content in pages:
        ends, found = [0], []
        for b, c in zip(base.to_pylist(), content.to_pylist(), strict=True):
            if c:
                p = _Links(b or "")
                p.feed(c)
                p.close()
                found += p.links
            ends.append(len(found))
        raw, absolute = (pa.array([x[i] for x in found], pa.string()) for i in (0, 1))
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([raw, absolute], ["raw", "absolute"]))


def parsed_links(base: Column, content: Column) -> Column:
    """``parsed(base, content)["links"]``, by a parse that makes nothing else."""
    return F.arrow_udf(_link_batches, LINKS).asNondeterministic()(base, content)


def parse_pages(pages: DataFrame, base_col: str, content_col: str, out: str = "parsed") -> DataFrame:
    """Adds the struct ``out``; null content parses as an empty page."""
    return pages.withColumn(out, parsed(F.col(base_col), F.col(content_col)))

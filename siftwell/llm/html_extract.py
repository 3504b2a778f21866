"""Main text of web pages, with site templates found by counting element subtrees per host.

Method.  Every page is cut into elements; each element's subtree (tags and text) has a hash.  Spark counts on how many pages of
a host each hash occurs.  Subtrees that recur on many pages of their host are template and go, with all they hold.  What the
tag names, roles, classes and ids say about menus, headers, footers, sidebars, notices, adverts, forms and comments by readers
goes as well, and so do scripts, styles and markup.

Plan.  Pass 1 parses pages (Arrow batches) and sends ``(host, hash)`` counts, pre-aggregated in each batch; the count is a
partial aggregate, so a host with a third of all pages is no bottleneck.  Only recurring hashes are kept, and they return to
their pages by a join on (host, page bucket): pass 2 parses again, deletes and writes text.  The kept hashes of a host are at
most a thousand times as many as the elements of its average page, for each is on a thousandth of its pages at least.  Pages are dealt
into slices of about 8 MB, and there are as many tasks as slices.  Parsing is one pass without recursion: its time follows the
page's length, however deep or broken the page is.

Which block recurs: an element of at least ``LEAST_TEXT`` characters of text, or with a link, that is on at least
``LEAST_PAGES`` pages and on a share ``SHARE`` of the pages of its host, or on ``MANY_PAGES`` pages of it (of a host of over
100,000 pages: a thousandth), for a section of a large site has its own menus.  An ``article`` or ``main`` element and what holds
one never goes by counting, for copies of a page are pages; nor do paragraphs, headings and lists inside one, for a
quotation that many articles share is text.

Names support this.  A class or id must be telling as a whole (``ad``, ``comments``, ``share-buttons``, ``cookie-notice``), for a
section may well be about menus or sharing (``menu-recipes``, ``related-work``); outside an article some more words are telling
alone (``menu``, ``footer``).  A paragraph, heading or list item goes only by a word that can mean nothing else (``advert``,
``comment``).  An ``article`` named as a reader's comment or reply is one.  Of a ``header`` inside an article its headings stay,
for they are the article's title; if it has no first heading, one that stands before it is taken.

Foreign content.  ``svg`` and ``template`` are elements without text of their own, which end at the latest with their parent, and
a paragraph or other block ends an ``svg`` that is open, as browsers have it.  The text of ``math`` and ``noscript`` is text.  An
``iframe``, ``title`` or ``textarea`` that is never closed is only a tag.

Defined cases: null html is empty; a page without article or main element yields what its body holds beside the blocks named
above; unclosed and mis-nested elements are closed by their parents, a menu that was never closed ends where the article
begins, and a page cut off anywhere keeps what it has; pages of any length and depth are read whole; equal pages count each,
and ties of counts don't arise, for every hash is judged by itself; null urls form one host; an empty table gives an empty
result; other columns play no part and may have any name.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize
from .near_dedup import slabs

LEAST_PAGES = 5
SHARE = 0.2
MANY_PAGES, MANY_SHARE = 100, 0.001
LEAST_TEXT = 20
SLICE_BYTES = 8 << 20

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it goes unread.
_RAW = frozenset("script style textarea title iframe".split())
#: Those of them that end with the page if nothing else ends them.
_TO_THE_END = frozenset(["script", "style"])
_FOREIGN = ("svg", "math")
_SILENT = _RAW | frozenset("svg template annotation annotation-xml object head canvas audio video select button".split())
_CHROME = frozenset("nav header footer aside form menu dialog".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_MAIN = frozenset(["article", "main"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_IN_HEAD = frozenset("title meta link style script base noscript template head".split())
#: What an element's opening closes among its open ancestors, up to the nearest barrier.
_CLOSES = {t: frozenset(["p"]) for t in _BLOCK} | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
_BARRIER = frozenset("article aside body div footer form header html main nav section table ul ol dl blockquote td th figure".split())
#: Elements that hold an article's own text.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: What can mean nothing else, of whatever element.
_PLAIN = r"ads?|adsbygoogle|adverts?|advertisements?|breadcrumbs?|comments?|commentlist|disqus|gdpr|sponsored"
_WORD = r"ads?|adsbygoogle|adverts?|advertisements?|breadcrumbs?|comments?|commentlist|replies|reply|respond|disqus|gdpr|masthead|navbar|navigation|navlinks|newsletter|pagination|popup|promo|promoted|share|sharing|sidebar|social|sponsored|subscribe|toolbar|topbar"
_PAIR = r"(?:ads?|adverts?|alert|banner|breadcrumbs?|comments?|consent|cookies?|discussion|disqus|feedback|footer|gdpr|menu|nav|newsletter|notice|popup|promo|related|repl(?:y|ies)|responses?|shar(?:e|ing)|sidebar|social|sponsored|subscribe|widget)[_-](?:area|articles|bar|banner|block|box|button|buttons|container|content|consent|form|icons|links|list|media|message|notice|pages|posts|section|share|signup|slot|stories|thread|unit|widget|wrapper)"
_BEFORE = r"(?:article|content|in|page|post|reader|site|top|user)[_-]"
#: One whole name of an element inside an article.
_INSIDE = re.compile(rf"(?:{_BEFORE})?(?:{_WORD}|{_PAIR}(?:[_-]\w+)?)")
_ONE_WORD = re.compile(_PLAIN)
#: More names that are telling outside an article.
_ALONE = r"alerts?|banner|consent|cookies?|feedback|footer|header|menu|nav|notices?|related|skip|sponsor|widget"
_OUTSIDE = re.compile(rf"(?:(?:{_BEFORE}|main[_-]|secondary[_-]|sub[_-]|bottom[_-])?(?:{_WORD}|{_ALONE})|(?:{_BEFORE})?{_PAIR}(?:[_-]\w+)?)")
#: Names of an article that is a reader's.
_READERS = re.compile(r"(?:\w+[_-])?(?:comment|reply)(?:[_-](?:body|content|item|text|\d+))?")
_HIDDEN = re.compile(r"display\s*:\s*none")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_TELLING = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style"])
_SPACE = re.compile(r"\s+")
_NOTHING: dict[str, str] = {}


class Node:
    __slots__ = ("tag", "attributes", "key", "size", "links", "main")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes


def _chrome(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id say that the element is no text; ``inside``: it is within an article."""
    tag, attributes = node.tag, node.attributes
    if tag in _CHROME:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    if _HIDDEN.search(attributes.get("style", "").lower()):
        return True
    if tag in ("body", "html", "main"):
        return False
    telling = _READERS if tag == "article" else _ONE_WORD if tag in _TEXTUAL and tag not in ("ul", "ol", "dl", "table", "figure") else _INSIDE if inside else _OUTSIDE
    return any(telling.fullmatch(x) for name in ("class", "id") for x in attributes.get(name, "").lower().split())


class _Open:
    """The open elements, and where in the stack those of each tag are: no search ever walks the stack."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.mains: list[int] = []

    def push(self, node: Node):
        i = len(self.nodes)
        self.at.setdefault(node.tag, []).append(i)
        if node.tag in _BARRIER:
            self.barriers.append(i)
        if node.tag in _MAIN:
            self.mains.append(i)
        self.nodes.append(node)

    def cut(self, to: int, events: list):
        """Closes all elements from place ``to`` on."""
        while len(self.nodes) > to:
            node = self.nodes.pop()
            self.at[node.tag].pop()
            if node.tag in _BARRIER:
                self.barriers.pop()
            if node.tag in _MAIN:
                self.mains.pop()
            events.append(None)

    def last(self, tag: str) -> int:
        x = self.at.get(tag)
        return x[-1] if x else -1

    def close_for(self, tag: str, events: list):
        """What the opening of ``tag`` closes."""
        if tag not in _IN_HEAD and (i := self.last("head")) >= 0:
            self.cut(i, events)
        if tag in _BLOCK:  # blocks end foreign content, but for what it says is HTML
            html = max(self.last("foreignobject"), self.last("annotation-xml"))
            foreign = [x[0] for t in _FOREIGN if (x := self.at.get(t)) and x[-1] > html]
            if foreign:
                self.cut(max(min(foreign), html + 1), events)
        closes = _CLOSES.get(tag)
        if not closes:
            return
        rows = tag in ("tr", "td", "th")
        wall = -1
        for i in reversed(self.barriers):
            if not (rows and self.nodes[i].tag in closes):
                wall = i
                break
        if rows:
            above = [x[k] for t in closes if (x := self.at.get(t)) and (k := bisect_right(x, wall)) < len(x)]
            if above:
                self.cut(min(above), events)
        else:
            i = max(self.last(t) for t in closes)
            if i > wall or (i == wall and i >= 0):
                self.cut(i, events)
        if tag in _MAIN and self.at.get("nav"):  # a menu that was never closed doesn't swallow the article
            self.cut(self.at["nav"][0], events)


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """The telling attributes of a tag whose name ends at ``at``; where it ends: after its ``>``, or -1 if the page ends first;
    whether it closes itself."""
    found, n = _NOTHING, len(page)
    while True:
        start, at = at, _GAP.match(page, at).end()
        if at >= n:
            return found, -1, False
        if page[at] == ">":
            return found, at + 1, at > start and page[at - 1] == "/"
        m = _ATTRIBUTE.match(page, at)
        name, value, at = m[0].lower(), "", m.end()
        m = _EQUALS.match(page, at)
        if m:
            at = m.end()
            quote = page[at] if at < n else ""
            if quote in ("'", '"') and last[quote] > at:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            elif quote:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        if name in _TELLING:
            if found is _NOTHING:
                found = {}
            found.setdefault(name, value)


def parse(page: str) -> list:
    """The page as a list of events: an element's ``Node`` where it opens, ``None`` where it closes, and texts as plain strings,
    character references not yet decoded."""
    events: list = []
    open_ = _Open()
    root = Node("html", _NOTHING)
    open_.push(root)
    events.append(root)
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "'\""}
    endless: set[str] = set()
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt + 1 >= n:
            events.append(page[at:])
            break
        c = page[lt + 1]
        name = _NAME.match(page, lt + 1) or (_NAME.match(page, lt + 2) if c == "/" else None)
        if name is None and c not in "!?/":  # a plain sign
            nxt = page.find("<", lt + 1)
            events.append(page[at : nxt if nxt >= 0 else n])
            at = nxt if nxt >= 0 else n
            continue
        if lt > at:
            events.append(page[at:lt])
        if name is None:
            end = page.find("-->", lt + 4) if page.startswith("<!--", lt) else page.find(">", lt)
            if end < 0:
                break
            at = end + (3 if page.startswith("<!--", lt) else 1)
            continue
        tag = name[0].lower()
        if c == "/":
            at = page.find(">", name.end()) + 1
            if not at:
                break
            i = open_.last(tag)
            # What lies in an article doesn't close what holds it.
            if i > 0 and (tag in ("body", "html") or not open_.mains or i >= open_.mains[-1]):
                open_.cut(i, events)
            continue
        attributes, at, closed = _attributes(page, name.end(), last)
        if at < 0:  # cut off inside a tag
            break
        open_.close_for(tag, events)
        if tag in _RAW:
            if not closed and tag not in endless:
                end = _RAW_END[tag].search(page, at)
                if end:
                    at = page.find(">", end.end()) + 1 or n
                elif tag in _TO_THE_END:
                    at = n
                else:
                    endless.add(tag)
            continue
        node = Node(tag, attributes)
        events.append(node)
        if tag in _VOID or closed:
            events.append(None)
        else:
            open_.push(node)
    open_.cut(0, events)
    return events


def measure(events: list, found: list | None) -> bool:
    """Sets keys, sizes and links; collects keys of subtrees that may be template.  Whether the page has an article."""
    stack: list[tuple[Node, list, bool]] = []
    within, any_main = False, False
    for e in events:
        if e is None:
            node, parts, inside = stack.pop()
            parts.append("<")
            node.key = xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)
            within = inside
            if stack and node.tag not in _SILENT:
                up, up_parts, _ = stack[-1]
                up.size += node.size
                up.links |= node.links
                up.main |= node.main
                up_parts.append(str(node.key))
            if found is not None and node.tag in _BLOCK and not node.main and node.tag not in ("html", "body") and not (inside and node.tag in _TEXTUAL) and (node.size >= LEAST_TEXT or (node.links and node.size)):
                found.append(node.key)
        elif isinstance(e, str):
            t = _SPACE.sub(" ", e).strip()
            if stack:
                stack[-1][0].size += len(t)
                stack[-1][1].append(t)
        else:
            e.size, e.links, e.main = 0, e.tag == "a", e.tag in _MAIN
            any_main |= e.main
            stack.append((e, [e.tag, ">"], within))
            within |= e.main
    return any_main


def text_of(page: str | None, template: frozenset | set) -> str:
    """The main text: blocks in page order, joined by an empty line."""
    if not page:
        return ""
    events = parse(page)
    # Keys are only needed to be looked up.
    any_main = measure(events, None) if template else any(isinstance(e, Node) and e.tag in _MAIN for e in events)
    whole = _collect(events, template, True) if any_main else None
    return _collect(events, template, False) if whole is None else whole


def _collect(events: list, template: frozenset | set, only_main: bool) -> str | None:
    """``None`` if only what is in articles is asked for and there is none beside page chrome."""
    blocks, cur, found = [], [], False
    lead: list[str] = []  # first headings before an article that has none
    own_title = False

    def flush():
        if not cur:
            return
        t = _SPACE.sub(" ", entities.unescape("".join(cur))).strip()
        cur.clear()
        if t:
            (lead if only_main and not mains else blocks).append(t)

    skip = 0  # open elements within, and including, one that goes
    mains, headers, titles, first = 0, 0, 0, 0
    stack: list[Node] = []
    for e in events:
        if skip:
            if e is None:
                skip -= 1
            elif not isinstance(e, str):
                skip += 1
            continue
        if isinstance(e, str):
            if (mains or not only_main or (first and not found)) and (titles or not headers):
                cur.append(e)
            continue
        if e is None:
            node = stack.pop()
            if node.tag in _BLOCK:
                flush()
            mains -= node.tag in _MAIN
            headers -= node.tag == "header"
            titles -= node.tag in _HEADINGS
            first -= node.tag == "h1"
            continue
        tag = e.tag
        inside = mains > 0
        own_header = tag == "header" and inside and not e.attributes.keys() & {"hidden", "aria-hidden", "role"}
        if tag in _SILENT or (not own_header and _chrome(e, inside)) or (template and e.key in template and tag in _BLOCK and not e.main and tag not in ("html", "body") and not (inside and tag in _TEXTUAL)):
            if tag in _BLOCK:
                flush()
            skip = 1
            continue
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            cur.append(" ")
        stack.append(e)
        if tag in _MAIN:
            mains, found = mains + 1, True
        headers += tag == "header"
        titles += tag in _HEADINGS
        first += tag == "h1"
        own_title |= tag == "h1" and mains > 0
    flush()
    if not own_title:
        blocks = lead + blocks
    return "\n\n".join(blocks) if found or not only_main else None


def _count(batches):
    for batch in batches:
        counts: Counter = Counter()
        for part in slabs(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                found: list = []
                if page:
                    measure(parse(page), found)
                counts.update((host, k) for k in set(found))
        yield pa.record_batch([pa.array([h for h, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["host", "key", "pages"])


def _extract(key, pages, keys):
    hosts = {}
    for h, k in zip(keys.column("of_host").to_pylist(), keys.column("keys").to_pylist(), strict=True):
        hosts[h] = frozenset(k)
    none: frozenset = frozenset()
    texts = [text_of(x, hosts.get(h, none)) for h, x in zip(pages.column("host").to_pylist(), pages.column("html").to_pylist(), strict=True)]
    return pa.table([pages.column("page_id"), pages.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text``."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), HOST, 1)).alias("host"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    counted = rows.select("host", "html").mapInArrow(_count, "host string, key long, pages long").groupBy("host", "key").agg(F.sum("pages").alias("pages"))
    # Keys of one page only, nearly all of them, go before anything else is done with them.
    often = counted.filter(F.col("pages") >= least_pages)
    per_host = rows.groupBy("host").agg(F.count("*").alias("in_host"))
    enough = F.least(F.col("in_host") * share, F.greatest(F.lit(float(many_pages)), F.col("in_host") * MANY_SHARE))
    template = often.join(per_host, "host").filter(F.col("pages") >= enough).groupBy("host").agg(F.collect_set("key").alias("keys"))
    template = materialize(template, "template")
    # Each slice of the pages meets the template keys of the hosts that it holds; a slice is a task, or nearly.
    slices = max(1, -(-int(rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]) // SLICE_BYTES))
    place = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("page_id", "html", place), F.lit(slices)).cast("int"))
    wanted = rows.select("slice", "host").distinct().join(template, "host").select(F.col("slice").alias("to_slice"), F.col("host").alias("of_host"), "keys")
    # As many tasks as slices, for their size is what bounds a task's.
    return rows.repartition(slices, "slice").groupBy("slice").cogroup(wanted.repartition(slices, "to_slice").groupBy("to_slice")).applyInArrow(_extract, "page_id long, url string, text string")

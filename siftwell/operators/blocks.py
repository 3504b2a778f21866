"""Markdown reports as a table of blocks: headings, paragraphs, lists, rules, quotations and table rows.

Block text carries a small inline markup that page renderers understand: ``<b> <i> <u> <br/>`` and a code font; all other
text is escaped.  Nested inline markup is flattened, links keep their text underlined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..schemas import BLOCK

EMPTY = "No report content."

_HEADING = re.compile(r"^(#{1,6})[ \t]*(.*?)[ \t]*#*[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"^ {0,3}[*+-][ \t]+(.*)$")
_NUMBER = re.compile(r"^ {0,3}\d+\.[ \t]+(.*)$")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_SPLIT_ROW = re.compile(r"(?<!\\)\|")
_DIVIDER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: How emphasis is written.  ``bold`` and ``slant`` hold text in both styles, which counts as the outer one.
_STARS = (
    r"\*{3}(?P<bold1>.+?)\*(?P<bold2>.*?)\*\*",
    r"\*{3}(?P<slant1>.+?)\*\*(?P<slant2>.*?)\*",
    r"\*\*(?!\*)(?P<bold3>[^*]+?)\*(?!\*)(?P<bold4>.+?)\*{3}",
    r"\*\*(?P<bold5>.+?)\*\*",
    r"\*(?P<slant3>[^*]+)\*",
)
_LOW_LINES = (
    r"_{3}(?P<bold6>.+?)_(?P<bold7>.*?)__",
    r"_{3}(?P<slant4>.+?)__(?P<slant5>.*?)_",
    r"(?<!\w)__(?!_)(?P<bold8>.+?)(?<!_)__(?!\w)",
    r"(?<!\w)_(?!_)(?P<slant6>.+?)(?<!_)_(?!\w)",
)
#: Marks between spaces are no marks; they stand aside while the others are read.
_ALONE = re.compile(r"(?:^|(?<=\s))(?:\*{1,3}|_{1,3})(?=\s|$)")
_ASIDE, _BACK = str.maketrans("*_", "\x02\x03"), str.maketrans("\x02\x03", "*_")
_INLINE = re.compile(
    r"(?P<escape>\\[\\`*_{}\[\]()>#+.!-])|(?P<tick>`+)(?P<code>.+?)(?P=tick)|!?\[(?P<link>[^\]]*)\]\([^)]*\)|<(?P<auto>https?://[^>\s]+)>|" + "|".join((*_STARS, *_LOW_LINES, r"(?P<br>\n)")),
    re.S,
)


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _pieces(text: str) -> Iterator[tuple[str, str]]:
    """The text as ``(style, content)`` in order; ``text`` is as it stands, the others are as written inside their marks."""
    at = 0
    for m in _INLINE.finditer(text):
        yield "text", text[at : m.start()]
        at = m.end()
        given = {k: v for k, v in m.groupdict().items() if v is not None}
        styled = lambda style: "".join(v for k, v in given.items() if k.startswith(style))  # noqa: E731, B023
        if "escape" in given:
            yield "text", given["escape"][1]
        elif "code" in given:
            yield "code", given["code"].strip()
        elif "br" in given:
            yield "br", "\n"
        elif "auto" in given:
            yield "auto", given["auto"]
        elif "link" in given:
            yield "image" if m[0].startswith("!") else "link", given["link"]
        elif any(k.startswith("bold") for k in given):
            yield "bold", styled("bold")
        else:
            yield "slant", styled("slant")
    yield "text", text[at:]


def plain(text: str) -> str:
    """Inline Markdown without its marks."""
    nested = ("link", "image", "bold", "slant")
    return "".join(plain(t) if style in nested else t for style, t in _pieces(_set_aside(text))).translate(_BACK)


def _set_aside(text: str) -> str:
    return _ALONE.sub(lambda m: m[0].translate(_ASIDE), text)


#: The markup of each style; an image has no text.
_MARKUP = {"bold": "<b>{}</b>", "slant": "<i>{}</i>", "link": "<u>{}</u>", "auto": "<u>{}</u>", "code": "<font size='9' face='Courier'>{}</font>", "br": "<br/>\n", "image": "", "text": "{}"}


def inline(text: str) -> str:
    """Inline Markdown as renderer markup."""
    nested = ("link", "bold", "slant")
    return "".join(_MARKUP[style].format(_escape(plain(t) if style in nested else t)) for style, t in _pieces(_set_aside(text))).translate(_BACK)


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [_escape(plain(c.strip())).strip() for c in _SPLIT_ROW.split(line)]


class _Lines:
    """Groups of lines, each a block."""

    def __init__(self, markdown: str):
        self.lines = markdown.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
        self.at = 0

    def more(self) -> bool:
        return self.at < len(self.lines)

    def take(self) -> str:
        self.at += 1
        return self.lines[self.at - 1]

    def peek(self, n: int = 0) -> str:
        return self.lines[self.at + n] if self.at + n < len(self.lines) else ""


def _items(lines: _Lines, pattern: re.Pattern) -> list[str]:
    """Items of a list; indented lines, nested items too, belong to the item above them."""
    items: list[list[str]] = []
    while lines.more():
        line = lines.peek()
        m = pattern.match(line)
        if _RULE.match(line):
            break
        if m and not (items and line.startswith("    ")):
            items.append([m[1]])
        elif items and line.strip() and (line.startswith("    ") or not (_HEADING.match(line) or _BULLET.match(line) or _NUMBER.match(line) or _QUOTE.match(line))):
            nested = _BULLET.match(line.lstrip()) or _NUMBER.match(line.lstrip())
            items[-1].append(nested[1] if nested else line.strip())
        elif not line.strip() and (pattern.match(lines.peek(1)) or lines.peek(1).startswith("    ")):
            pass
        else:
            break
        lines.take()
    return [t for t in (inline("\n".join(i)) for i in items) if t.strip()]


def markdown_blocks(markdown: str | None) -> list[dict]:
    """The block records of one report, in order."""
    blocks: list[dict] = []

    def add(kind: str, text: str = "", level: int = 0, items: list[str] | None = None) -> None:
        blocks.append({"seq": len(blocks), "kind": kind, "level": level, "text": text, "items": items or []})

    lines = _Lines(markdown or "")
    while lines.more():
        line = lines.peek()
        if not line.strip():
            lines.take()
        elif m := _HEADING.match(line):
            lines.take()
            add("heading", inline(m[2]), min(len(m[1]), 4))
        elif line.strip() and re.fullmatch(r"=+[ ]*|-+[ ]*", lines.peek(1)) and not _BULLET.match(line) and not _QUOTE.match(line):
            lines.take()
            add("heading", inline(line.strip()), 1 if lines.take().startswith("=") else 2)
        elif _RULE.match(line):
            lines.take()
            add("spacer")
            add("rule")
            add("spacer")
        elif _BULLET.match(line) or _NUMBER.match(line):
            kind, pattern = ("bullets", _BULLET) if _BULLET.match(line) else ("numbers", _NUMBER)
            if items := _items(lines, pattern):
                add(kind, items=items)
        elif _QUOTE.match(line):
            quoted = []
            while lines.more() and lines.peek().strip():
                m = _QUOTE.match(lines.peek())
                quoted.append(m[1] if m else lines.peek())
                lines.take()
            text = " ".join(" ".join(b["text"].split()) if not b["items"] else " ".join(b["items"]) for b in markdown_blocks("\n".join(quoted)) if b["text"] != EMPTY)
            text = _escape(re.sub(r"<br/>|</?[biu]>|<font[^>]*>|</font>", "", text).replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&").strip())
            if text:
                add("quote", text)
        elif "|" in line and _DIVIDER.match(lines.peek(1)) and "-" in lines.peek(1) and len(_cells(line)) == len(_cells(lines.peek(1))):
            width = len(_cells(line))
            add("table_header", " | ".join(_cells(lines.take())))
            lines.take()
            while lines.more() and lines.peek().strip():
                add("table_row", " | ".join((_cells(lines.take()) + [""] * width)[:width]))
        elif line.startswith("    "):
            code = []
            while lines.more() and (lines.peek().startswith("    ") or not lines.peek().strip()):
                code.append(lines.take()[4:])
            add("body", _escape("\n".join(code).strip()))
        else:
            text = []
            while lines.more() and lines.peek().strip() and not _HEADING.match(lines.peek()) and not (text and re.fullmatch(r"=+[ ]*|-+[ ]*", lines.peek(1))):
                text.append(lines.take().strip())
            body = inline("\n".join(text or [lines.take().strip()]))
            if body.strip():
                add("body", body)
    return blocks or [{"seq": 0, "kind": "body", "level": 0, "text": EMPTY, "items": []}]


def _blocks_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([markdown_blocks(t) for t in texts])


def md_blocks(reports: DataFrame, key: str = "audit_id", markdown: str = "markdown_report") -> DataFrame:
    """One row per block: ``key, seq, kind, level, text, items``."""
    udf = F.pandas_udf(_blocks_of, f"array<struct<{', '.join(f.replace(' ', ': ', 1) for f in BLOCK.split(', '))}>>")
    return reports.select(F.col(key), F.explode(udf(F.col(markdown))).alias("b")).select(key, "b.*")


def cover_blocks(url: Column, created_at: Column) -> Column:
    """The four blocks before a report's body: title, URL, date and rule."""
    row = lambda i, kind, text: F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    date = F.date_format(created_at, "dd MMMM yyyy 'at' HH:mm 'UTC'")
    return F.array(row(0, "title", F.lit("SEO Audit Report")), row(1, "cover_url", escape_xml(url)), row(2, "cover_date", F.concat(F.lit("Generated: "), date)), row(3, "rule", F.lit("")))

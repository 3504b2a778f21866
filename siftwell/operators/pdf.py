"""Reports as PDF files: A4 pages with 20 mm margins, the blocks of a report in styles, inline markup in the base fonts.

The base fonts have the characters of Windows code page 1252; others are shown as question marks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

from .blocks import markdown_blocks

FONTS = {"plain": "Helvetica", "bold": "Helvetica-Bold", "slant": "Helvetica-Oblique", "code": "Courier"}
_NUMBER = {name: i for i, name in enumerate(FONTS, 1)}
_WIDTH, _HEIGHT, _MARGIN = 595.0, 842.0, 56.7
_NAVY, _DARK, _GREY = "0.1 0.2 0.4", "0.15 0.15 0.15", "0.45 0.45 0.45"


class Style(NamedTuple):
    """Size, font and colour of a block, its space above and below, and its indent, in points."""

    size: float
    font: str = "plain"
    colour: str = _DARK
    above: float = 0.0
    below: float = 6.0
    indent: float = 0.0


STYLES = {
    "title": Style(24, "bold", _NAVY, 0, 8),
    "cover_url": Style(11, "plain", _GREY),
    "cover_date": Style(9, "plain", _GREY, 0, 10),
    "h1": Style(18, "bold", _NAVY, 16, 8),
    "h2": Style(15, "bold", _NAVY, 12, 6),
    "h3": Style(13, "bold", _DARK, 8, 4),
    "h4": Style(11, "bold", _DARK, 6, 3),
    "body": Style(10),
    "item": Style(10, "plain", _DARK, 0, 3, 16),
    "quote": Style(10, "slant", _GREY, 0, 6, 24),
    "table_header": Style(9, "bold", _NAVY, 4, 3),
    "table_row": Style(9, "plain", _DARK, 0, 3),
}

_TAG = re.compile(r"(<br/>\n?|</?[biu]>|<font[^>]*>|</font>|\n)")
_NARROW, _WIDE = frozenset("fijlrtI.,:;'|!()[]- "), frozenset("mwMWABCDEGHKNOQRUVXY@%&")
Run = tuple[str, str]


def _advance(text: str, font: str, size: float) -> float:
    """The text's width, on the wide side, from three classes of letters."""
    if font == "code":
        return 0.6 * size * len(text)
    return size * sum(0.34 if c in _NARROW else 0.9 if c in _WIDE else 0.6 for c in text)


def _runs(markup: str, font: str) -> Iterator[Run]:
    """``(font, text)`` of renderer markup; a text of one line feed is a line's end."""
    now = [font]
    for part in _TAG.split(markup):
        if part in ("<b>", "<i>", "<u>") or part.startswith("<font"):
            now.append({"<b>": "bold", "<i>": "slant", "<u>": now[-1]}.get(part, "code"))
        elif part in ("</b>", "</i>", "</u>", "</font>"):
            now.pop()
        elif part == "\n" or part.startswith("<br/>"):
            yield font, "\n"
        elif part:
            yield now[-1], part.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def _lines(markup: str, style: Style, start: str = "") -> Iterator[list[Run]]:
    """The runs of each line, broken at spaces, or within words that are wider than a line."""
    room = _WIDTH - 2 * _MARGIN - style.indent
    line, used = [(style.font, start)] if start else [], _advance(start, style.font, style.size)
    for font, text in _runs(markup, style.font):
        if text == "\n":
            yield line
            line, used = [], 0.0
            continue
        for word in re.findall(r"\S+\s*|\s+", text):
            while word:
                wide = _advance(word.rstrip(), font, style.size)
                if used + wide <= room:
                    line.append((font, word))
                    used += _advance(word, font, style.size)
                    break
                if used > 0:
                    yield line
                    line, used = [], 0.0
                    continue
                fits = max(1, int(room / (0.9 * style.size)))
                yield [(font, word[:fits])]
                word = word[fits:]
    yield line


def _styled(url: str, created: str, markdown: str | None) -> Iterator[tuple[str, Style, str, str]]:
    """Kind, style, start and markup of everything on the pages."""
    safe = url.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    yield "text", STYLES["title"], "", "SEO Audit Report"
    yield "text", STYLES["cover_url"], "", safe
    yield "text", STYLES["cover_date"], "", f"Generated: {created}"
    yield "rule", STYLES["body"], "", ""
    for b in markdown_blocks(markdown):
        kind = b["kind"]
        if kind in ("rule", "spacer"):
            yield kind, STYLES["body"], "", ""
        elif kind in ("bullets", "numbers"):
            for i, t in enumerate(b["items"], 1):
                yield "text", STYLES["item"], "• " if kind == "bullets" else f"{i}. ", t
        else:
            yield "text", STYLES[f"h{b['level']}" if kind == "heading" else kind], "", b["text"]


def _string(text: str) -> bytes:
    text = "".join(c if c >= " " else " " for c in text)
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def _pages(url: str, created: str, markdown: str | None) -> Iterator[bytes]:
    """The drawing operators of each page."""
    page, y = [], _HEIGHT - _MARGIN
    for kind, style, start, markup in _styled(url, created, markdown):
        if kind == "spacer":
            y -= 6
            continue
        if kind == "rule":
            y -= 4
            page.append(b"0.7 G %.1f %.1f m %.1f %.1f l S" % (_MARGIN, y, _WIDTH - _MARGIN, y))
            y -= 6
            continue
        y -= style.above
        for line in _lines(markup, style, start):
            y -= style.size * 1.4
            if y < _MARGIN:
                yield b"\n".join(page)
                page, y = [], _HEIGHT - _MARGIN - style.size * 1.4
            shown = b" ".join(b"/F%d %g Tf (%s) Tj" % (_NUMBER[font], style.size, _string("".join(t for _, t in part))) for font, part in groupby(line, lambda r: r[0]))
            page.append(b"BT %s rg %.1f %.1f Td %s ET" % (style.colour.encode(), _MARGIN + style.indent, y, shown))
        y -= style.below
    yield b"\n".join(page)


def render_pdf(url: str, created: str, markdown: str | None) -> bytes:
    """The file of one report: cover lines, then its blocks."""
    first = 3 + len(FONTS)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /%s /Encoding /WinAnsiEncoding >>" % name.encode() for name in FONTS.values()]
    fonts = b" ".join(b"/F%d %d 0 R" % (i, i + 2) for i in _NUMBER.values())
    for drawn in _pages(url, created, markdown):
        data = zlib.compress(drawn)
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(data), data))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << %s >> >> /Contents %d 0 R >>" % (_WIDTH, _HEIGHT, fonts, len(objects)))
    kids = range(first + 1, len(objects) + 1, 2)
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)

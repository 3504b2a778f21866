"""String helpers whose semantics Spark's own differ from: Unicode-wide stripping and line splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", "")


def split_lines(c: Column) -> Column:
    """At every line boundary, the rarer ones included."""
    return F.split(c, r"\R|[\x1c-\x1e]")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def after_colon(line: Column) -> Column:
    """What follows a line's first colon, stripped."""
    return strip(F.regexp_replace(line, r"(?s)\A[^:]*:", ""))


def escape_xml(c: Column) -> Column:
    """The three characters that break XML text, the ampersand first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c

"""Markup removal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A tag starts with a letter, "/", "!" or "?" right after "<", so text such
# as "p < 0.05 and x > 3" (unescaped by the XML reader) is kept.
TAG_RE = r"<[A-Za-z/!?][^>]*>"
# Fixed value: the original pattern, whose class excludes ")" instead of ">":
# "<b>bar</b>" loses its text, "<i>f(x)</i>" keeps it.
COMPAT_RE = r"\s*\<[^)]*\>"


def strip_markup(markup: Column, compat: bool = False) -> Column:
    """Tags removed, text kept; null stays null."""
    return F.regexp_replace(markup, COMPAT_RE if compat else TAG_RE, "")

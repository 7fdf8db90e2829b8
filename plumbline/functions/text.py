"""Markup and pattern functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.functions.scalars import BLANKS, _col

# Markup characters and their escapes; the ampersand has to come first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    for plain, escaped in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def visible_text(c: Column | str) -> Column:
    """Tags become a blank and blanks collapse; entities, script bodies and the ends stay."""
    return F.regexp_replace(F.regexp_replace(_col(c), "<[^>]+>", " "), f"{BLANKS}+", " ")


def extract_links(c: Column | str, pattern: str, prefer: str, origin: Column | str) -> Column:
    """Distinct matches of group 1 in order of appearance, those containing ``prefer`` first,
    each behind ``origin``.
    """
    links = F.array_distinct(F.regexp_extract_all(_col(c), F.lit(pattern), 1))
    first = F.filter(links, lambda x: F.contains(x, F.lit(prefer)))
    rest = F.filter(links, lambda x: ~F.contains(x, F.lit(prefer)))
    base = F.rtrim(_col(origin), F.lit("/"))
    return F.transform(F.concat(first, rest), lambda x: F.concat(base, x))


def extract_pair(c: Column | str, re_a: str, re_b: str) -> Column:
    """Struct of the first match of both patterns; NULL unless both match."""
    c = _col(c)
    both = c.rlike(re_a) & c.rlike(re_b)
    return F.when(
        both, F.struct(F.regexp_extract(c, re_a, 1).alias("a"), F.regexp_extract(c, re_b, 1).alias("b"))
    )

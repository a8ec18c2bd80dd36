"""Cleaning of page texts: site header, leading breadcrumbs, stock headings, spacing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, col, trim_ws

# Stock headings that are dropped wherever they stand alone.
STOCK_HEADINGS = ("table of contents", "quick access", "further information")


def clean_full_text(c: str | Column, header: str | None = None) -> Column:
    """The text as one line without what stands before its content.

    header: a pattern taken off the start once. Then blank lines and breadcrumbs (11 to 149 characters, 3 to 14 words, most
    of them capitalised, no full stop) are dropped until a line of content is seen, stock headings everywhere. Null and
    empty texts give an empty one.
    """
    t = F.coalesce(col(c), F.lit(""))
    if header:
        t = F.regexp_replace(t, rf"\A(?:{header})", "")
    lines = F.transform(F.split(trim_ws(t), "\n"), trim_ws)
    words = lambda x: F.split(x, rf"{WS}+")
    capital = lambda x: F.size(F.filter(words(x), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}"))))
    crumb = lambda x: (F.char_length(x) < 150) & (F.char_length(x) > 10) & (F.size(words(x)) > 2) & (F.size(words(x)) < 15) & (capital(x) / F.size(words(x)) > 0.6) & ~F.contains(x, F.lit("."))
    stock = lambda x: F.lower(x).isin(*STOCK_HEADINGS)
    # content begins at the first line that is neither blank nor a breadcrumb nor a stock heading
    opening = F.transform(lines, lambda x: (x != "") & ~crumb(x) & ~stock(x))
    at = F.coalesce(F.nullif(F.array_position(opening, F.lit(True)), F.lit(0)), F.size(lines) + 1)
    body = F.array_join(F.filter(lines, lambda x, i: (i + 1 >= at) & ~stock(x)), " ")
    flat = F.regexp_replace(body, rf"{WS}+", " ")
    return trim_ws(F.regexp_replace(F.regexp_replace(flat, r" +([.,;:!?)])", "$1"), r"([(]) +", "$1"))

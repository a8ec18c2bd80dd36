"""Text functions over columns: normalisers, predicates, hashes, slugs. All are built-in expressions and stay in the JVM.

Nulls give null unless said otherwise; empty texts give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f\x0B]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+$", "")


def clean_whitespace(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trim_ws(F.regexp_replace(col(c), rf"{WS}+", " "))


def normalize_text(c: str | Column) -> Column:
    """Trimmed, with every line feed and carriage return as one space."""
    return F.translate(trim_ws(c), "\n\r", "  ")


def nonblank(c: str | Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(trim_ws(c) != "", col(c))


def words(c: str | Column) -> Column:
    """Pieces between runs of white space; none of a blank text."""
    t = trim_ws(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"{WS}+"))


def alnum_count(c: str | Column) -> Column:
    return F.char_length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def alnum_ratio(c: str | Column) -> Column:
    """Share of letters and digits; 0 of an empty text."""
    n = F.char_length(col(c))
    return F.when(n == 0, 0.0).otherwise(alnum_count(c) / n)


def sentences(c: str | Column) -> Column:
    """Trimmed non-empty pieces between runs of . ! ?"""
    return F.filter(F.transform(F.split(col(c), "[.!?]+"), trim_ws), lambda x: x != "")


def chunk_valid(c: str | Column) -> Column:
    """At least 40 % letters and digits and at least 15 words."""
    return (F.char_length(col(c)) > 0) & (alnum_count(c) >= F.char_length(col(c)) * 0.4) & (F.size(words(c)) >= 15)


def is_thin(embedding_text: Column, cleaned: Column) -> Column:
    """Too little content to be found: short, little text, or mostly short pieces between points."""
    pieces = F.filter(F.transform(F.split(cleaned, r"\."), trim_ws), lambda x: x != "")
    short = F.size(F.filter(pieces, lambda x: F.char_length(x) < 80))
    dense = F.greatest(F.char_length(cleaned), F.lit(1))
    return (F.char_length(cleaned) < 400) | (F.char_length(embedding_text) < 600) | (alnum_count(cleaned) / dense < 0.5) | ((F.size(pieces) > 5) & (short / F.greatest(F.size(pieces), F.lit(1)) > 0.7))


def match_form(c: str | Column, ampersand: bool = False) -> Column:
    """Lower case, everything but a-z, 0-9 and German letters as one space, trimmed; with `ampersand`, & reads as 'and'."""
    t = F.lower(col(c))
    if ampersand:
        t = F.replace(t, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(t, "[^a-z0-9äöüß]+", " "))


def thread_key(c: str | Column) -> Column:
    """A key of lower-case letters, digits and @ . _ -, 'unknown' if nothing is left."""
    t = F.regexp_replace(F.lower(trim_ws(F.coalesce(col(c), F.lit("")))), "[^a-z0-9@._-]+", "_")
    t = F.regexp_replace(F.regexp_replace(t, "_+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("unknown"))


def slugify(c: str | Column) -> Column:
    """Lower-case words joined by hyphens, at most 80 characters."""
    t = F.regexp_replace(trim_ws(F.lower(col(c))), "[’'“”\"().,:;!?]", "")
    t = F.regexp_replace(F.regexp_replace(t, rf"{WS}+", "-"), "[^a-z0-9-]", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(t, "-+", "-"), "^-+|-+$", ""), 1, 80)


def url_host(c: str | Column) -> Column:
    """Lower-case host and port of a URL, empty if there is none."""
    return F.lower(F.regexp_extract(col(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: str | Column) -> Column:
    return F.regexp_extract(col(c), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def strip_think(c: str | Column) -> Column:
    return trim_ws(F.regexp_replace(col(c), "(?is)<think>.*?</think>", ""))


def excerpt(c: str | Column, limit: int = 2000, least: int = 1000) -> Column:
    """The first `limit` characters, cut behind the last '. ' if that is behind `least` and the text goes on."""
    head = F.substring(col(c), 1, limit)
    at = F.char_length(head) - F.locate(" .", F.reverse(head))  # 1-based place of the last '.' that a space follows
    has = F.locate(" .", F.reverse(head)) > 0
    return trim_ws(F.when((F.char_length(col(c)) > limit) & has & (at - 1 > least), F.substring(head, F.lit(1), at)).otherwise(head))


def count_of(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


#: Damaged sequences and what they stood for, in the order in which they are repaired.
MOJIBAKE = (
    ("Ã¤", "ä"), ("Ã¶", "ö"), ("Ã¼", "ü"), ("Ã„", "Ä"), ("Ã–", "Ö"), ("Ãœ", "Ü"), ("ÃŸ", "ß"), ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("â€“", "–"), ("â€”", "—"), ("Â", ""),
)


def fix_encoding(c: str | Column) -> Column:
    t = col(c)
    for bad, good in MOJIBAKE:
        t = F.replace(t, F.lit(bad), F.lit(good))
    return t


def first_match(c: str | Column, *patterns: str) -> Column:
    """Of several patterns the first one's first match; null if none matches."""
    return F.coalesce(*(F.nullif(F.regexp_extract(col(c), p, 0), F.lit("")) for p in patterns))


def all_matches(c: str | Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def distinct_folded(a: Column, most: int) -> Column:
    """Trimmed entries, of those equal but for case the first, at most `most`."""
    t = F.transform(a, trim_ws)
    low = F.transform(t, F.lower)
    return F.slice(F.filter(t, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, most)

"""Richer facts in texts: amounts as numbers, ranges of credits, levels of language, deadlines with their semester, steps with dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import all_matches, col, first_match, trim_ws

DATE = r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
AMOUNT = r"(?:EUR|€) ?([0-9]{1,6}(?:[.,][0-9]{2})?)"
SEMESTER = r"(?:winter|summer) semester [0-9]{2,4}(?:/[0-9]{2})?"
LEVEL = r"(?:^|[^A-Za-z0-9])([ABC][12])(?:[^A-Za-z0-9.]|$)"


def amounts(c: str | Column) -> Column:
    """All euro amounts as numbers, in order, repeated ones kept."""
    return F.transform(all_matches(c, AMOUNT, 1), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def amount_summary(c: str | Column) -> Column:
    """struct<n, least, most, total> of a text's amounts; nulls but for n where there is none."""
    a = amounts(c)
    total = F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 2)
    return F.struct(F.size(a).alias("n"), F.array_min(a).alias("least"), F.array_max(a).alias("most"), F.when(F.size(a) > 0, total).alias("total"))


def credit_range(c: str | Column) -> Column:
    """struct<least, most> of the numbers of credits named; null fields where none is."""
    n = F.transform(all_matches(c, "([0-9]{1,3}) (?:ECTS|credits|Leistungspunkte|Punkten)", 1), lambda x: x.cast("int"))
    return F.struct(F.array_min(n).alias("least"), F.array_max(n).alias("most"))


def language_levels(c: str | Column) -> Column:
    """Distinct levels (A1 to C2) in ascending order."""
    return F.array_sort(F.array_distinct(all_matches(c, LEVEL, 1)))


def deadline(c: str | Column) -> Column:
    """struct<date, semester>: the first date behind a word of finality, and the first semester named."""
    when = F.nullif(F.regexp_extract(col(c), rf"(?:before|until|by|ab dem|Bis zum|bis zum|Nach dem) ({DATE})", 1), F.lit(""))
    return F.struct(when.alias("date"), first_match(c, SEMESTER).alias("semester"))


def steps(c: str | Column) -> Column:
    """array<struct<step_number, title, date>> of a text's numbered lines."""
    numbered = F.filter(F.split(col(c), "\n"), lambda s: F.regexp_like(s, F.lit(r"^\s*[0-9]+[.)]\s")))
    return F.transform(numbered, lambda s, i: F.struct((i + 1).alias("step_number"), trim_ws(F.regexp_replace(s, r"^\s*[0-9]+[.)]\s+", "")).alias("title"), first_match(s, DATE).alias("date")))


FEE = rf"([A-Za-zÄÖÜäöüß]{{3,30}}) (?:of|is|von|beträgt|kostet) {AMOUNT}"
TEST = r"(TOEFL|IELTS|DSH|TestDaF|DSD|telc|Cambridge)[^0-9\n]{0,20}([0-9]{1,3}(?:[.,][0-9])?)"
PERSON = r"((?:Dr\. |Prof\. )?[A-ZÄÖÜ][a-zäöüß]+ [A-ZÄÖÜ][a-zäöüß]+)[ ,:]{1,3}[<(]?([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


def _pairs(c: str | Column, pattern: str, first: str, second: str) -> Column:
    return F.zip_with(all_matches(c, pattern, 1), all_matches(c, pattern, 2), lambda a, b: F.struct(a.alias(first), b.alias(second)))


def fee_breakdown(c: str | Column, most: float = 100_000.0) -> Column:
    """array<struct<label, amount>>: amounts with the word they are of; amounts of nothing or over `most` are no fees."""
    got = F.transform(_pairs(c, FEE, "label", "amount"), lambda x: F.struct(F.lower(x["label"]).alias("label"), F.replace(x["amount"], F.lit(","), F.lit(".")).cast("double").alias("amount")))
    return F.filter(got, lambda x: (x["amount"] > 0) & (x["amount"] <= most))


def test_details(c: str | Column) -> Column:
    """array<struct<test, score>> of language tests named with a score."""
    return F.transform(_pairs(c, TEST, "test", "score"), lambda x: F.struct(x["test"].alias("test"), F.replace(x["score"], F.lit(","), F.lit(".")).cast("double").alias("score")))


def contact_persons(c: str | Column, offices: tuple[str, ...] = ("Office", "Team", "Desk", "Büro", "Service")) -> Column:
    """array<struct<name, email>> of names with an address right behind; names that are those of an office are left out, addresses are in lower case."""
    got = _pairs(c, PERSON, "name", "email")
    kept = F.filter(got, lambda x: ~F.exists(F.array(*map(F.lit, offices)), lambda o: F.contains(x["name"], o)))
    return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), F.lower(x["email"]).alias("email")))


def requirement_lines(c: str | Column, terms: tuple[str, ...] = ("required", "must", "need", "muss", "müssen", "vorliegen"), most: int = 10) -> Column:
    """The first `most` lines of a list, without their bullets, or sentences that ask for something."""
    pieces = F.transform(F.split(col(c), r"\n|(?<=[.!?]) "), trim_ws)
    asks = lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), t))
    return F.slice(F.transform(F.filter(pieces, lambda x: F.char_length(x).between(15, 200) & asks(x)), lambda x: F.regexp_replace(x, r"^[-•*] *", "")), 1, most)

"""Signals in text: amounts, dates, actions, contacts, programme facts. Built-in expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, all_matches, clean_whitespace, col, distinct_folded, first_match, trim_ws

# Months, modal verbs and terms the extractors look for.
MONTHS_EN = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTHS_DE = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
MODAL = ("must", "need to", "required to", "should", "have to", "necessary to")
ELIGIBLE = ("eligible", "eligibility", "requirements", "required", "can apply", "may apply", "qualify", "qualification")
DOCUMENT_TERMS = ("certificate", "proof", "copy", "transcript", "form", "card", "document", "letter", "application", "insurance", "passport")

_NUMBER = r"[0-9]{1,6}(?:[.,][0-9]{2})?"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"[+49 \t\r\n\f\x0B]*[(]?[0-9]{{2,4}}[)]?[-. \t\r\n\f\x0B]?[0-9]{{2,4}}[-. \t\r\n\f\x0B]?[0-9]{{2,4}}[-. \t\r\n\f\x0B]?[0-9]{{0,4}}"
HOURS = r"(?i)(?:Monday|Tuesday|Wednesday|Thursday|Friday|Mon|Tue|Wed|Thu|Fri).*?[0-9]{1,2}:[0-9]{2}.*?[0-9]{1,2}:[0-9]{2}"


def euro_amounts(c: str | Column) -> Column:
    """Up to ten distinct amounts beside a euro sign or word, sorted as strings."""
    found = F.concat(all_matches(c, rf"€{WS}*({_NUMBER})", 1), all_matches(c, rf"({_NUMBER}){WS}*€", 1), all_matches(c, rf"(?i)({_NUMBER}){WS}*(?:EUR|Euro|euros)", 1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, 10)


def date_ranges(c: str | Column) -> Column:
    """Up to eight dates: ranges first, then days, then days with month names; distinct but for case."""
    named = rf"(?i)(?:^|[^\w])([0-9]{{1,2}}(?:st|nd|rd|th)?{WS}+(?:{MONTHS_EN})|(?:{MONTHS_EN}){WS}+[0-9]{{1,2}}(?:st|nd|rd|th)?)"
    found = F.concat(all_matches(c, rf"[0-9]{{1,2}}\.[0-9]{{1,2}}\.{WS}*[-–—]{WS}*[0-9]{{1,2}}\.[0-9]{{1,2}}\."), all_matches(c, r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})?"), all_matches(c, named, 1))
    return distinct_folded(found, 8)


def sentences_with(c: str | Column, terms: tuple[str, ...], least: int, most: int, n: int = 8) -> Column:
    """The first `n` sentences of `least` to `most` characters with one of the terms."""
    pieces = F.transform(F.split(col(c), "[.!?]+"), trim_ws)
    has = lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), t))
    return F.slice(F.transform(F.filter(pieces, lambda x: (F.char_length(x) >= least) & (F.char_length(x) <= most) & has(x)), clean_whitespace), 1, n)


def key_actions(c: str | Column) -> Column:
    return sentences_with(c, MODAL, 20, 200)


def eligibility_cues(c: str | Column) -> Column:
    return sentences_with(c, ELIGIBLE, 25, 180)


def required_documents(c: str | Column) -> Column:
    """Up to ten lines that name a document, in the first section under a heading about required documents that has any."""
    head = r"(?i)(?:Which documents|Required documents|Documents required|Application documents)[^\n]*\n?((?:[^\n]+\n?){0,15})"
    names = lambda x: (F.char_length(x) >= 10) & (F.char_length(x) <= 120) & F.exists(F.array(*map(F.lit, DOCUMENT_TERMS)), lambda t: F.contains(F.lower(x), t))
    sections = F.transform(all_matches(c, head, 1), lambda s: F.transform(F.filter(F.transform(F.split(s, "\n"), trim_ws), names), lambda x: clean_whitespace(F.regexp_replace(x, rf"^[-•*]{WS}*", ""))))
    return F.slice(F.coalesce(F.get(F.filter(sections, lambda s: F.size(s) > 0), F.lit(0)), F.array().cast("array<string>")), 1, 10)


def program_facts(c: str | Column) -> Column:
    """struct<language, intake, ects, duration>, fields null where nothing is said."""
    low = F.lower(col(c))
    has = lambda *t: F.exists(F.array(*map(F.lit, t)), lambda x: F.contains(low, x))
    return F.struct(
        F.when(has("taught in english", "english-taught", "english language", "b2 english", "c1 english"), "English").when(has("taught in german", "german-taught", "b2 german", "c1 german"), "German").alias("language"),
        F.when(has("winter semester") & has("summer semester"), "winter+summer").when(has("winter semester", "starts in winter"), "winter").when(has("summer semester", "starts in summer"), "summer").alias("intake"),
        F.nullif(F.regexp_extract(col(c), rf"([0-9]{{2,3}}){WS}*ECTS", 1), F.lit("")).alias("ects"),
        F.nullif(F.regexp_replace(F.regexp_extract(low, rf"([0-9]){WS}*semester", 1), "^([0-9])$", "$1 semesters"), F.lit("")).alias("duration"),
    )


def signal_block(object_type: Column, c: str | Column) -> Column:
    """Lines of retrieval hints by type of object; empty for other types and texts without any."""
    t = col(c)
    line = lambda label, a, sep, end="": F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, sep), F.lit(end)))
    f = program_facts(c)
    facts = F.array_compact(F.array(*(F.when(f[n].isNotNull(), F.concat(F.lit(f"{n}="), f[n])) for n in ("language", "intake", "ects", "duration"))))
    process = F.concat_ws("\n", line("Deadlines mentioned: ", date_ranges(t), ", "), line("Key actions: ", key_actions(t), " | "), line("Required documents: ", required_documents(t), "; "))
    fees = F.concat_ws("\n", line("Amounts mentioned: ", euro_amounts(t), ", ", " EUR"), line("Eligibility cues: ", eligibility_cues(t), " | "))
    return F.when(object_type == "application_process", process).when(object_type == "fees_funding_rule", fees).when(object_type == "degree_program", F.concat_ws("\n", line("Program facts: ", facts, ", "))).otherwise("")


def first_email(c: str | Column) -> Column:
    return first_match(c, r"[\w.-]+@[\w.-]+\.\w+")


def first_date(c: str | Column) -> Column:
    """The first German date, else the first English one."""
    return first_match(c, rf"[0-9]{{1,2}}\.{WS}*(?:{MONTHS_DE}){WS}*[0-9]{{4}}", rf"[0-9]{{1,2}}{WS}+(?:{MONTHS_EN}){WS}+[0-9]{{4}}")


def contacts(c: str | Column) -> Column:
    """array<struct<type, value>>: up to five addresses, three phone numbers, two office hours."""
    of = lambda kind, a, n: F.transform(F.slice(a, 1, n), lambda x: F.struct(F.lit(kind).alias("type"), trim_ws(x).alias("value")))
    return F.concat(of("email", all_matches(c, EMAIL), 5), of("phone", all_matches(c, PHONE), 3), of("office_hours", all_matches(c, HOURS), 2))


def dates_and_deadlines(c: str | Column) -> Column:
    """Up to ten distinct dates (five of each form) in sorted order."""
    forms = (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", rf"(?i)[0-9]{{1,2}}{WS}+(?:{MONTHS_EN}){WS}+[0-9]{{2,4}}", rf"(?i)(?:{MONTHS_EN}){WS}+[0-9]{{1,2}},?{WS}+[0-9]{{2,4}}")
    return F.slice(F.array_sort(F.array_distinct(F.concat(*(F.slice(all_matches(c, p), 1, 5) for p in forms)))), 1, 10)


def clean_contacts(a: Column) -> Column:
    """Contacts without phone numbers that are dates or have not 10 to 15 digits and without malformed addresses; addresses in lower case."""
    digits = lambda x: F.char_length(F.regexp_replace(x, "[^0-9]", ""))
    phone = lambda x: ~F.regexp_like(x["value"], F.lit(r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}")) & digits(x["value"]).between(10, 15)
    email = lambda x: F.regexp_like(F.lower(x["value"]), F.lit(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"))
    kept = F.filter(a, lambda x: F.when(x["type"] == "phone", phone(x)).when(x["type"] == "email", email(x)).otherwise(F.lit(True)))
    return F.transform(kept, lambda x: F.struct(x["type"].alias("type"), F.when(x["type"] == "email", F.lower(x["value"])).otherwise(trim_ws(x["value"])).alias("value")))


def clean_dates(a: Column) -> Column:
    """Dates with a digit; of entries longer than 100 characters only the date inside."""
    inside = lambda x: first_match(x, r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", rf"[0-9]{{1,2}}{WS}+(?:{MONTHS_EN}){WS}+[0-9]{{4}}")
    return F.filter(F.transform(a, lambda x: F.when(F.char_length(x) > 100, inside(x)).otherwise(trim_ws(x))), lambda x: x.isNotNull() & F.regexp_like(x, F.lit("[0-9]")))

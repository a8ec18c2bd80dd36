"""Typed objects and the texts that are embedded for them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_full_text
from ..functions.extract import signal_block
from ..functions.text import clean_whitespace, excerpt, is_thin
from ..session import cut


def embedding_texts(objects: DataFrame, header: str | None = None) -> DataFrame:
    """object_id, embedding_text, enriched, related_used, is_thin_before, still_thin of every object.

    objects: object_id (unique), object_type, title, url, classification_notes, related_pages, full_text. The text is made
    of identity, signals, up to ten related pages and the cleaned text; a thin object also gets an excerpt of its best
    neighbour: of those with 400 characters or more the longest, its own type before others, overviews last, ties by link order.
    """
    clean = objects.withColumn("_clean", clean_full_text("full_text", header))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    identity = F.concat_ws("\n", F.concat(F.lit("Object type: "), F.coalesce("object_type", F.lit("unknown"))), F.concat(F.lit("Object id: "), "object_id"), F.concat(F.lit("Title: "), text("title")), F.concat(F.lit("URL: "), text("url")), F.when(text("classification_notes") != "", F.concat(F.lit("Classification notes: "), "classification_notes")))
    signals = F.nullif(signal_block(F.coalesce("object_type", F.lit("")), "_clean"), F.lit(""))
    related = F.when(F.size("related_pages") > 0, F.concat(F.lit("Related pages: "), F.array_join(F.slice("related_pages", 1, 10), ", ")))
    base = clean.withColumn("_base", F.concat_ws("\n\n", identity, signals, related, F.concat(F.lit("Full text:\n"), "_clean")))
    base = cut(base.select("object_id", "object_type", "related_pages", "full_text", "_clean", "_base"))  # used three times, and dear to compute
    base = base.withColumn("_thin", is_thin(F.col("_base"), F.col("_clean")))
    edges = base.where("_thin").select("object_id", F.col("object_type").alias("_own"), F.posexplode("related_pages").alias("_pos", "_dst"))
    near = base.where(F.char_length("full_text") >= 400).select(F.col("object_id").alias("_dst"), F.col("object_type").alias("_type"), F.char_length("full_text").alias("_len"), excerpt("_clean").alias("_excerpt"))
    score = F.col("_len") + F.when(F.col("_type").eqNullSafe(F.col("_own")), 10000).otherwise(0) - F.when(F.col("_type") == "overview_navigation", 5000).otherwise(0)
    best = edges.join(near, "_dst").groupBy("object_id").agg(F.max(F.struct(score.alias("s"), (-F.col("_pos")).alias("p"), F.col("_dst"), F.col("_excerpt"))).alias("_b"))
    j = base.join(best, "object_id", "left").withColumn("_add", F.nullif("_b._excerpt", F.lit("")))
    full = F.when(F.col("_add").isNotNull(), F.concat("_base", F.lit("\nRelated content excerpt from "), F.col("_b._dst"), F.lit(":\n"), "_add")).otherwise(F.col("_base"))
    still = F.col("_thin") & (F.coalesce(F.size("related_pages"), F.lit(0)) > 0) & is_thin(full, F.concat(F.col("_clean"), F.coalesce("_add", F.lit(""))))
    return j.select("object_id", full.alias("embedding_text"), F.col("_add").isNotNull().alias("enriched"), F.when(F.col("_add").isNotNull(), F.col("_b._dst")).alias("related_used"), F.col("_thin").alias("is_thin_before"), still.alias("still_thin"))


@dataclass(frozen=True)
class Page:
    """What a builder sees of a page, as columns without nulls: title, object_id, notes, text, related (array<string>), items of lists (array<string>), sections (array<struct<heading, content>>)."""

    title: Column
    object_id: Column
    notes: Column
    text: Column
    related: Column
    items: Column
    sections: Column


#: Builders by class: from a Page to a struct column.
BUILDERS: dict[str, Callable[[Page], Column]] = {}


def register_builder(kind: str) -> Callable[[Callable[[Page], Column]], Callable[[Page], Column]]:
    """Adds or replaces the builder of a class of pages."""

    def add(build: Callable[[Page], Column]) -> Callable[[Page], Column]:
        BUILDERS[kind] = build
        return build

    return add


def _about(p: Column, word: str) -> Column:
    return F.filter(p, lambda r: F.contains(r, F.lit(word)))


def _says(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w))
    return out


def _kind_of(object_id: Column) -> Column:
    """What follows the first hyphen of an id."""
    return F.when(F.contains(object_id, F.lit("-")), F.regexp_extract(object_id, "^[^-]*-(.*)$", 1)).otherwise("general")


def steps_of(sections: Column, most: int = 10) -> Column:
    """Sections with a numbered or step heading, with their place among all; where there are none the first `most` sections."""
    every = F.transform(sections, lambda s, i: F.struct((i + 1).alias("step_number"), s["heading"].alias("title"), s["content"].alias("description")))
    marked = F.filter(every, lambda s: F.regexp_like(s["title"], F.lit(r"^[0-9]+\.?\s|(?i:step\s+[0-9]+)")))
    return F.when(F.size(marked) > 0, marked).otherwise(F.slice(every, 1, most))


# Fixed values in the builders below: classes, names of fields and the labels that a field may have, as consumers of the
# objects expect them.
@register_builder("degree_program")
def _degree_program(p: Page) -> Column:
    fact = lambda word, label: F.when(_says(p.text, word), label)
    semesters = F.regexp_extract(p.text, r"([0-9]{1,2})\s*(?:[Ss]emesters|[Ss]emester\b)", 1)
    credits = F.regexp_extract(p.text, r"([0-9]{2,3})\s*(?:ECTS|credits|Leistungspunkte)", 1)
    info = F.struct(
        F.trim(F.regexp_replace(p.title, r"\s*\([^)]*\)", "")).alias("name"), F.coalesce(fact("master", "Master"), fact("bachelor", "Bachelor"), F.lit("")).alias("degree_type"),
        F.regexp_extract(p.text, r"\b([BM]\.?(?:Sc|A|Eng)\.?)(?=\W|$)", 1).alias("degree_abbreviation"), F.nullif(semesters, F.lit("")).cast("int").alias("duration_semesters"), F.nullif(credits, F.lit("")).cast("int").alias("ects_credits"),
        F.coalesce(fact("english", "English"), fact("german", "German"), F.lit("")).alias("language"), F.array_compact(F.array(fact("winter semester", "winter"), fact("summer semester", "summer"))).alias("start_semesters"))
    return F.struct(info.alias("program_info"), F.struct(_about(p.related, "curriculum").alias("related_curriculum_pages")).alias("curriculum"), F.struct(_about(p.related, "application").alias("related_application_pages")).alias("application_info"))


@register_builder("curriculum_page")
def _curriculum(p: Page) -> Column:
    info = F.struct(_about(p.related, "degree_program").alias("program_reference"), F.when(_says(p.title, "elective"), "elective").otherwise("core").alias("module_type"))
    return F.struct(info.alias("curriculum_info"), F.transform(p.items, lambda x: F.struct(x.alias("description"))).alias("modules"))


@register_builder("application_process")
def _process(p: Page) -> Column:
    until = F.struct(F.when(_says(p.text, "july 15"), "July 15").alias("winter_semester"), F.when(_says(p.text, "january 15"), "January 15").alias("summer_semester"))
    mail = F.nullif(F.regexp_extract(p.text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0), F.lit(""))
    return F.struct(F.struct(p.title.alias("name"), p.notes.alias("description")).alias("process_info"), steps_of(p.sections).alias("steps"), until.alias("deadlines"), F.struct(mail.alias("email")).alias("contact"))


@register_builder("application_route_rule")
def _route(p: Page) -> Column:
    scope = F.when(_says(p.title, "visa"), "External requirement").otherwise("Internal requirement")
    return F.struct(F.struct(_kind_of(p.object_id).alias("rule_type"), scope.alias("scope"), p.notes.alias("description")).alias("rule_info"))


@register_builder("language_proof_rule")
def _language(p: Page) -> Column:
    spoken = F.when(_says(p.title, "german", "dsh"), "German").when(_says(p.title, "english"), "English")
    return F.struct(F.struct(spoken.alias("language"), p.title.alias("test_name"), p.notes.alias("description")).alias("language_info"))


@register_builder("fees_funding_rule")
def _fees(p: Page) -> Column:
    kind = F.when(_says(p.title, "funding", "scholarship"), "funding").otherwise("fee")
    return F.struct(F.struct(kind.alias("type"), p.notes.alias("description"), F.regexp_extract_all(p.text, F.lit(r"(?:€|EUR)\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]{2})?)"), F.lit(1)).alias("amounts_mentioned")).alias("financial_info"))


@register_builder("deadline_rule")
def _deadlines(p: Page) -> Column:
    kind = F.when(_says(p.title, "application"), "application_period").otherwise("academic_calendar")
    return F.struct(F.struct(kind.alias("type"), p.notes.alias("description")).alias("deadline_info"), F.struct(F.regexp_extract_all(p.text, F.lit(r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4})?"), F.lit(0)).alias("dates_mentioned")).alias("dates"))


@register_builder("special_category")
def _category(p: Page) -> Column:
    return F.struct(F.struct(_kind_of(p.object_id).alias("category_type"), p.notes.alias("purpose"), _says(p.title, "ukraine", "crisis").alias("time_bound")).alias("category_info"))


@register_builder("faq_support")
def _faq(p: Page) -> Column:
    both = F.filter(p.sections, lambda s: (s["heading"] != "") & (s["content"] != ""))
    return F.struct(F.struct(p.title.alias("topic"), p.notes.alias("description")).alias("faq_info"), F.transform(both, lambda s: F.struct(s["heading"].alias("question"), s["content"].alias("answer"))).alias("questions"))


@register_builder("overview_navigation")
def _overview(p: Page) -> Column:
    return F.struct(F.struct(p.notes.alias("purpose"), p.title.alias("scope")).alias("navigation_info"), p.related.alias("child_pages"))


@register_builder("accessibility_support")
def _accessibility(p: Page) -> Column:
    return F.struct(F.struct(p.title.alias("service_type"), p.notes.alias("scope")).alias("support_info"))


@register_builder("family_support")
def _family(p: Page) -> Column:
    return F.struct(F.struct(p.title.alias("service_type"), F.array(F.lit("students with children")).alias("who_for"), p.notes.alias("description")).alias("support_info"))


@register_builder("university_profile")
def _profile(p: Page) -> Column:
    return F.struct(F.struct(p.title.alias("department"), p.notes.alias("offerings")).alias("profile_info"))


def content_of(text: Column, sections: Column, limit: int = 500) -> Column:
    """struct<full_text, sections, summary>: the text in one line, the sections, the first section's beginning with three points."""
    first = F.substring(F.coalesce(F.get(sections, F.lit(0))["content"], F.lit("")), 1, limit)
    return F.struct(clean_whitespace(text).alias("full_text"), sections.alias("sections"), F.when(first != "", F.concat(clean_whitespace(first), F.lit("..."))).alias("summary"))


def build_objects(pages: DataFrame, key: str, kind: str, title: str, object_id: str, notes: str, text: str, related: str, items: str, sections: str) -> DataFrame:
    """`key`, object_type and object_json: metadata, what the class's builder makes, related_pages and content; classes without a builder have no middle part.

    items: array<string>; sections: array<struct<heading, content>>; nulls count as empty. One projection, no Python.
    """
    t, o, n, x = (F.coalesce(F.col(c), F.lit("")) for c in (title, object_id, notes, text))
    strings = F.array().cast("array<string>")
    rows = F.transform(F.coalesce(F.col(sections), F.array().cast("array<struct<heading:string,content:string>>")), lambda s: F.struct(F.coalesce(s["heading"], F.lit("")).alias("heading"), F.coalesce(s["content"], F.lit("")).alias("content")))
    own = pages.select(key, F.col(kind).alias("object_type"), t.alias("_t"), o.alias("_o"), n.alias("_n"), x.alias("_x"), F.coalesce(related, strings).alias("_r"), F.coalesce(items, strings).alias("_i"), rows.alias("_s"))
    page = Page(*(F.col(c) for c in ("_t", "_o", "_n", "_x", "_r", "_i", "_s")))
    body = None
    for name, build in sorted(BUILDERS.items()):
        j = F.to_json(build(page))
        body = F.when(F.col("object_type") == name, j) if body is None else body.when(F.col("object_type") == name, j)
    inner = lambda j: F.substring(j, 2, F.char_length(j) - 2)
    head = F.to_json(F.struct(F.struct(page.object_id.alias("object_id"), F.col("object_type"), page.title.alias("title"), page.notes.alias("classification_notes")).alias("metadata")))
    tail = F.to_json(F.struct(page.related.alias("related_pages"), content_of(page.text, page.sections).alias("content")))
    return own.select(key, "object_type", F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(inner(head), F.nullif(inner(body), F.lit("")), inner(tail))), ","), F.lit("}")).alias("object_json"))

"""Passages, cleaned texts, embedded texts, pages and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import clean_full_text as clean
from ..operators import objects as O
from ..operators.chunking import chunk_texts, fixed_chunks
from ..session import table
from .registry import query
from .texts import _W, trim_sql

HEADER = r"[A-ZÄÖÜ][^\n]{2,40} University of Crafts(?:\s*[-–—]\s*studies, research, further training)?"


@query("chunk_fixed", """
    WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 900 THEN 1 ELSE ceil((length(text) - 900) / 750.0)::INTEGER + 1 END AS n FROM documents WHERE text IS NOT NULL),
    i AS (SELECT doc_id, text, unnest(range(n)) AS i FROM n)
    SELECT doc_id, i::INTEGER AS chunk_index, (i * 750)::INTEGER AS start_char, least(i * 750 + 900, length(text))::INTEGER AS end_char, md5(substring(text, i * 750 + 1, 900)) AS text_md5 FROM i""")  # fmt: skip
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 900 characters, 150 of them shared, without Python."""
    c = table(spark, d, "documents").select("doc_id", F.posexplode(fixed_chunks(F.col("text"))).alias("chunk_index", "c"))
    return c.select("doc_id", "chunk_index", "c.start_char", "c.end_char", F.md5("c.text").alias("text_md5"))


@query("chunk_boundary")
def chunk_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Passages that end at paragraph or sentence breaks, enough of them for the length; title and type are carried along."""
    return chunk_texts(table(spark, d, "documents"), ["doc_id", "title", "object_type"], "text")


_WORDS = f"regexp_split_to_array(x, '{_W}+')"
_CRUMB = f"(length(x) < 150 AND length(x) > 10 AND len({_WORDS}) > 2 AND len({_WORDS}) < 15 AND len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / len({_WORDS}) > 0.6 AND NOT contains(x, '.'))"
_STOCK = "lower(x) IN ('table of contents', 'quick access', 'further information')"
_HEADLESS = f"regexp_replace(coalesce(content.full_text, ''), '^(?:{HEADER})', '')"
_SPACED = "regexp_replace(regexp_replace(b, ' +([.,;:!?)])', '\\1', 'g'), '([(]) +', '\\1', 'g')"


@query("clean_full_text", f"""
    WITH l AS (SELECT snapshot_id, list_transform(string_split({trim_sql(_HEADLESS)}, E'\\n'), lambda x: {trim_sql('x')}) AS l FROM overview_pages),
    o AS (SELECT snapshot_id, l, coalesce(nullif(list_position(list_transform(l, lambda x: x <> '' AND NOT {_CRUMB} AND NOT {_STOCK}), true), 0), len(l) + 1) AS at_ FROM l),
    b AS (SELECT snapshot_id, regexp_replace(array_to_string(list_filter(l, lambda x, i: i >= at_ AND NOT {_STOCK}), ' '), '{_W}+', ' ', 'g') AS b FROM o)
    SELECT snapshot_id, {trim_sql(_SPACED)} AS v FROM b""")  # fmt: skip
def clean_full_text(spark: SparkSession, d: str) -> DataFrame:
    """Page texts as one line without header and leading breadcrumbs."""
    return table(spark, d, "overview_pages").select("snapshot_id", clean("content.full_text", HEADER).alias("v"))


@query("chunk_boundary_check", """
    SELECT doc_id, length(text) AS n_chars, TRUE AS in_order, TRUE AS in_text, TRUE AS in_size FROM documents WHERE length(text) > 2500""")  # fmt: skip
def chunk_boundary_check(spark: SparkSession, d: str) -> DataFrame:
    """Of every long document whether its passages are in order, are what stands at their places, and keep to the size."""
    docs = table(spark, d, "documents").where(F.char_length("text") > 2500).select("doc_id", F.col("text").alias("whole"))
    c = chunk_texts(docs, ["doc_id", "whole"], "whole")
    own = F.regexp_replace(F.expr("substring(whole, start_char + 1, end_char - start_char)"), r"^[\s\x{A0}]+|[\s\x{A0}]+$", "") == F.col("chunk_text")
    per = c.groupBy("doc_id").agg(F.max(F.char_length("whole")).cast("long").alias("n_chars"), F.array_sort(F.collect_list(F.struct("chunk_index", "start_char", "end_char"))).alias("p"), F.every(own).alias("in_text"), F.every(F.col("end_char") - F.col("start_char") <= 1100).alias("in_size"))
    order = (F.size("p") == 1) | F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (F.get("p", i)["start_char"] > F.get("p", i - 1)["start_char"]) & (F.get("p", i)["chunk_index"] == i))
    return per.select("doc_id", "n_chars", order.alias("in_order"), "in_text", "in_size")


def _objects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "overview_pages").select("snapshot_id", "related_pages", F.col("content.full_text").alias("full_text"), "metadata.object_id", "metadata.object_type", "metadata.title", "metadata.url", "metadata.classification_notes")
    last = p.groupBy("object_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return p.join(last.select("snapshot_id"), "snapshot_id").where("object_id IS NOT NULL")


@query("build_embedding_text")
def build_embedding_text(spark: SparkSession, d: str) -> DataFrame:
    """The text to embed for the last snapshot of every page, enriched from a neighbour where it is thin."""
    return O.embedding_texts(_objects(spark, d), HEADER)


@query("extract_links", """
    SELECT id, array_to_string(list_filter(list_transform(links, lambda l: l.url), lambda u: contains(u, '/en/')), ' ') AS en_links FROM web_documents""")  # fmt: skip
def extract_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_documents").select("id", F.array_join(F.filter(F.transform("links", lambda x: x["url"]), lambda u: F.contains(u, F.lit("/en/"))), " ").alias("en_links"))


def _built(spark: SparkSession, d: str) -> DataFrame:
    """Objects of the stored pages: their steps are the sections, their bulleted lines the items of lists."""
    o = table(spark, d, "site_objects").where(F.expr("try_parse_json(raw_json)").isNotNull())
    text = F.coalesce(F.get_json_object("raw_json", "$.content.full_text"), F.lit(""))
    steps = F.from_json(F.get_json_object("raw_json", "$.steps"), "array<struct<title:string,description:string>>")
    items = F.transform(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit("^[•*-] "))), lambda x: F.substring(x, 3, 1 << 30))
    rows = o.select("id", "object_type", "title", "object_id", F.col("classification_notes").alias("notes"), text.alias("text"), "related_pages", items.alias("items"), F.transform(steps, lambda s: F.struct(s["title"].alias("heading"), s["description"].alias("content"))).alias("sections"))
    return O.build_objects(rows, "id", "object_type", "title", "object_id", "notes", "text", "related_pages", "items", "sections")


_OBJECTS = """
    o AS (SELECT id, object_type, coalesce(title, '') AS title, coalesce(object_id, '') AS object_id, coalesce(classification_notes, '') AS notes, coalesce(related_pages, []) AS related, coalesce(raw_json->>'$.content.full_text', '') AS text,
      coalesce(CAST(json_transform(raw_json->'$.steps', '[{"title": "VARCHAR", "description": "VARCHAR"}]') AS STRUCT(title VARCHAR, description VARCHAR)[]), []) AS steps FROM (SELECT * FROM site_objects WHERE json_valid(raw_json)))"""


def _part(spark: SparkSession, d: str, path: str, kind: str) -> DataFrame:
    return _built(spark, d).select("id", "object_type", F.from_json(F.get_json_object("object_json", path), kind).alias("x")).where("x IS NOT NULL")


@query("build_objects", f"WITH {_OBJECTS} SELECT id, object_type, object_id, title, len(related)::INTEGER AS n_related, trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g')) AS full_text, len(steps)::INTEGER AS n_sections FROM o")
def build_objects(spark: SparkSession, d: str) -> DataFrame:
    """Typed objects of pages by their class: metadata and content, read back from the built JSON."""
    j = lambda p: F.get_json_object("object_json", p)
    n = lambda p, k: F.coalesce(F.size(F.from_json(j(p), f"array<{k}>")), F.lit(0))
    return _built(spark, d).select("id", "object_type", j("$.metadata.object_id").alias("object_id"), j("$.metadata.title").alias("title"), n("$.related_pages", "string").alias("n_related"), j("$.content.full_text").alias("full_text"), n("$.content.sections", "struct<heading:string>").alias("n_sections"))


@query("object_steps", f"""
    WITH {_OBJECTS}, s AS (SELECT id, steps, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS n FROM o WHERE object_type = 'application_process'),
    k AS (SELECT *, regexp_matches(coalesce(s.title, ''), '^[0-9]+\\.?\\s|(?i:step\\s+[0-9]+)') AS marked, max(CASE WHEN regexp_matches(coalesce(s.title, ''), '^[0-9]+\\.?\\s|(?i:step\\s+[0-9]+)') THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS has FROM s)
    SELECT id, n::INTEGER AS step_number, coalesce(s.title, '') AS title, coalesce(s.description, '') AS description FROM k WHERE marked OR has = 0 AND n <= 10""")  # fmt: skip
def object_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of processes: numbered headings, else the first ten sections."""
    return _part(spark, d, "$.steps", "array<struct<step_number:int,title:string,description:string>>").where("object_type = 'application_process'").select("id", F.inline("x"))


@query("object_questions", f"""
    WITH {_OBJECTS}, s AS (SELECT id, unnest(steps) AS s FROM o WHERE object_type = 'faq_support') SELECT id, s.title AS question, s.description AS answer FROM s WHERE s.title <> '' AND s.description <> ''""")  # fmt: skip
def object_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers of pages that have them: every section with heading and content."""
    return _part(spark, d, "$.questions", "array<struct<question:string,answer:string>>").select("id", F.inline("x"))


@query("object_modules", f"""
    WITH {_OBJECTS} SELECT id, unnest(list_transform(list_filter(string_split(text, E'\\n'), lambda x: regexp_matches(x, '^[•*-] ')), lambda x: substr(x, 3))) AS description FROM o WHERE object_type = 'curriculum_page'""")  # fmt: skip
def object_modules(spark: SparkSession, d: str) -> DataFrame:
    """Modules of curriculum pages: the items of all their lists."""
    return _part(spark, d, "$.modules", "array<struct<description:string>>").where("object_type = 'curriculum_page'").select("id", F.inline("x"))


@query("object_related", f"""
    WITH {_OBJECTS} SELECT id, 'curriculum' AS kind, r FROM (SELECT id, unnest(related) AS r FROM o WHERE object_type = 'degree_program') WHERE contains(r, 'curriculum')
    UNION ALL SELECT id, 'application', r FROM (SELECT id, unnest(related) AS r FROM o WHERE object_type = 'degree_program') WHERE contains(r, 'application')""")  # fmt: skip
def object_related(spark: SparkSession, d: str) -> DataFrame:
    """Curriculum and application pages of programmes."""
    b = _built(spark, d).where("object_type = 'degree_program'")
    of = lambda k, p: b.select("id", F.lit(k).alias("kind"), F.explode(F.from_json(F.get_json_object("object_json", p), "array<string>")).alias("r"))
    return of("curriculum", "$.curriculum.related_curriculum_pages").unionAll(of("application", "$.application_info.related_application_pages"))


_FACTS = {
    "program_info.name": ("degree_program", "trim(regexp_replace(title, '\\s*\\([^)]*\\)', '', 'g'))"),
    "program_info.degree_type": ("degree_program", "CASE WHEN contains(lower(text), 'master') THEN 'Master' WHEN contains(lower(text), 'bachelor') THEN 'Bachelor' ELSE '' END"),
    "program_info.ects_credits": ("degree_program", "nullif(regexp_extract(text, '([0-9]{2,3})\\s*(?:ECTS|credits|Leistungspunkte)', 1), '')"),
    "program_info.language": ("degree_program", "CASE WHEN contains(lower(text), 'english') THEN 'English' WHEN contains(lower(text), 'german') THEN 'German' ELSE '' END"),
    "curriculum_info.module_type": ("curriculum_page", "CASE WHEN contains(lower(title), 'elective') THEN 'elective' ELSE 'core' END"),
    "process_info.name": ("application_process", "title"),
    "contact.email": ("application_process", "nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 0), '')"),
    "rule_info.rule_type": ("application_route_rule", "CASE WHEN contains(object_id, '-') THEN regexp_extract(object_id, '^[^-]*-(.*)$', 1) ELSE 'general' END"),
    "rule_info.scope": ("application_route_rule", "CASE WHEN contains(lower(title), 'visa') THEN 'External requirement' ELSE 'Internal requirement' END"),
    "language_info.language": ("language_proof_rule", "CASE WHEN contains(lower(title), 'german') OR contains(lower(title), 'dsh') THEN 'German' WHEN contains(lower(title), 'english') THEN 'English' END"),
    "language_info.test_name": ("language_proof_rule", "title"),
    "financial_info.type": ("fees_funding_rule", "CASE WHEN contains(lower(title), 'funding') OR contains(lower(title), 'scholarship') THEN 'funding' ELSE 'fee' END"),
    "category_info.category_type": ("special_category", "CASE WHEN contains(object_id, '-') THEN regexp_extract(object_id, '^[^-]*-(.*)$', 1) ELSE 'general' END"),
    "category_info.time_bound": ("special_category", "CASE WHEN contains(lower(title), 'ukraine') OR contains(lower(title), 'crisis') THEN 'true' ELSE 'false' END"),
    "faq_info.topic": ("faq_support", "title"),
    "support_info.service_type": ("accessibility_support", "title"),
    "support_info.scope": ("accessibility_support", "notes"),
}


@query("object_facts", f"WITH {_OBJECTS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{path}' AS field, {sql} AS value FROM o WHERE object_type = '{kind}'" for path, (kind, sql) in _FACTS.items()) + ") WHERE value IS NOT NULL")
def object_facts(spark: SparkSession, d: str) -> DataFrame:
    """Single values of every class's object."""
    facts = F.filter(F.array(*(F.when(F.col("object_type") == kind, F.struct(F.lit(path).alias("field"), F.get_json_object("object_json", f"$.{path}").alias("value"))) for path, (kind, _) in _FACTS.items())), lambda x: x["value"].isNotNull())
    return _built(spark, d).select("id", F.inline(facts))


@query("page_sections", """
    WITH s AS (SELECT snapshot_id, unnest(content.sections) AS s, unnest(range(len(content.sections))) AS pos FROM overview_pages)
    SELECT snapshot_id, pos::INTEGER AS pos, s.heading AS heading, s.level::INTEGER AS level, length(s.content)::INTEGER AS chars FROM s""")  # fmt: skip
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "overview_pages").select("snapshot_id", F.posexplode("content.sections").alias("pos", "s"))
    return s.select("snapshot_id", "pos", F.col("s.heading").alias("heading"), F.col("s.level").cast("int").alias("level"), F.char_length("s.content").alias("chars"))


@query("first_sections", """
    SELECT snapshot_id, CASE WHEN length(content.sections[1].content) > 500 THEN left(content.sections[1].content, 500) || '...' ELSE content.sections[1].content END AS summary FROM overview_pages WHERE len(content.sections) > 0""")  # fmt: skip
def first_sections(spark: SparkSession, d: str) -> DataFrame:
    """A summary from the first section."""
    c = F.get("content.sections", F.lit(0))["content"]
    return table(spark, d, "overview_pages").where(F.size("content.sections") > 0).select("snapshot_id", F.when(F.char_length(c) > 500, F.concat(F.substring(c, 1, 500), F.lit("..."))).otherwise(c).alias("summary"))


@query("snapshot_history", """
    SELECT metadata.page_id AS page_id, count(*) AS snapshots, count(DISTINCT md5(content.full_text)) AS versions, strftime(max(fetched_at), '%Y-%m-%d') AS last_fetch FROM overview_pages GROUP BY 1""")  # fmt: skip
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "overview_pages")
    return p.groupBy(F.col("metadata.page_id").alias("page_id")).agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct(F.md5("content.full_text")).alias("versions"), F.date_format(F.max("fetched_at"), "yyyy-MM-dd").alias("last_fetch"))

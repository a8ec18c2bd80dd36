"""Text functions and extractors as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..session import table
from .registry import query

_W = "[ \\t\\r\\n\\f\\v]"
trim_sql = lambda c: f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
ws_sql = lambda c: trim_sql(f"regexp_replace({c}, '{_W}+', ' ', 'g')")
match_sql = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9äöüß]+', ' ', 'g'))"


def _per_row(name: str, tab: str, key: str, sql: str, make):
    """A query of one computed column per row: both engines' expression of it."""

    @query(name, f"SELECT {key}, {sql} AS v FROM {tab}")
    def plan(spark: SparkSession, d: str) -> DataFrame:
        c = make()
        return table(spark, d, tab).select(key, (c if isinstance(c, Column) else F.lit(c)).alias("v"))

    plan.__doc__ = f"`{name}` of every row of {tab}."
    return plan


_per_row("normalize_text", "web_chunks", "id", f"translate({trim_sql('text')}, E'\\n\\r', '  ')", lambda: T.normalize_text("text"))
_per_row("clean_whitespace", "web_chunks", "id", ws_sql("text"), lambda: T.clean_whitespace("text"))
_per_row("normalize_match", "web_documents", "id", f"trim(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9äöüß]+', ' ', 'g'))", lambda: T.match_form("title", True))
_slug = trim_sql("lower(title)")
_PUNCT = "[’''“”\"().,:;!?]"
_slug = f"regexp_replace(regexp_replace({_slug}, '{_PUNCT}', '', 'g'), '{_W}+', '-', 'g')"
_slug = f"regexp_replace(regexp_replace(regexp_replace({_slug}, '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
_per_row("slugify", "documents", "doc_id", f"left({_slug}, 80)", lambda: T.slugify("title"))
_keyed = trim_sql("coalesce(thread_id, subject, '')")
_key = f"regexp_replace(lower({_keyed}), '[^a-z0-9@._-]+', '_', 'g')"
_key = f"regexp_replace(regexp_replace({_key}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"
_per_row("thread_key", "email_requests", "request_id", f"coalesce(nullif({_key}, ''), 'unknown')", lambda: T.thread_key(F.coalesce("thread_id", "subject", F.lit(""))))
_per_row("content_hash", "documents", "doc_id", f"sha256(concat({trim_sql('text')}, coalesce(title, '')))", lambda: F.sha2(F.concat(T.trim_ws("text"), F.coalesce("title", F.lit(""))), 256))
_per_row("page_id_hash", "site_objects", "id", "left(sha256(url), 16)", lambda: F.substring(F.sha2("url", 256), 1, 16))
_per_row("url_host", "web_documents", "id", "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))", lambda: T.url_host("url"))
_per_row("content_quality", "documents", "doc_id", f"concat(length(text), '/', round(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) * 1000 / greatest(length(text), 1))::BIGINT, '/', len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {trim_sql('x')}), lambda x: x <> '')))",
         lambda: F.concat(F.char_length("text").cast("string"), F.lit("/"), F.round(T.alnum_count("text") * 1000 / F.greatest(F.char_length("text"), F.lit(1))).cast("long").cast("string"), F.lit("/"), F.size(T.sentences("text")).cast("string")))
_per_row("text_profile", "chunks", "id", f"CASE WHEN {trim_sql('chunk_text')} = '' THEN 0 ELSE len(regexp_split_to_array({trim_sql('chunk_text')}, '{_W}+')) END::INTEGER", lambda: F.size(T.words("chunk_text")))
_per_row("strip_think", "documents", "doc_id", trim_sql("regexp_replace('<think>plan for ' || doc_id || '</think> ' || text, '(?is)<think>.*?</think>', '', 'g')"), lambda: T.strip_think(F.concat(F.lit("<think>plan for "), F.col("doc_id").cast("string"), F.lit("</think> "), F.col("text"))))
_per_row("fix_encoding", "documents", "doc_id", "replace(replace(replace(replace(text, 'Ã¤', 'ä'), 'Ã¼', 'ü'), 'â€™', ''''), 'Â', '')", lambda: T.fix_encoding(F.col("text")))
_per_row("excerpt", "documents", "doc_id", trim_sql("CASE WHEN length(text) > 2000 AND instr(reverse(left(text, 2000)), ' .') > 0 AND 2000 - instr(reverse(left(text, 2000)), ' .') - 1 > 1000 THEN left(text, 2000 - instr(reverse(left(text, 2000)), ' .')::INTEGER) ELSE left(text, 2000) END"), lambda: T.excerpt("text"))
_per_row("chunk_id_hash", "qa_pairs", "id", "sha256(concat(question, answer))", lambda: F.sha2(F.concat("question", "answer"), 256))
_per_row("first_email", "email_requests", "request_id", r"nullif(regexp_extract(email_text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+', 0), '')", lambda: T.first_match("email_text", r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"))
_per_row("first_date", "documents", "doc_id", f"coalesce(nullif(regexp_extract(text, '[0-9]{{1,2}}\\.{_W}*(?:{X.MONTHS_DE}){_W}*[0-9]{{4}}', 0), ''), nullif(regexp_extract(text, '[0-9]{{1,2}}{_W}+(?:{X.MONTHS_EN}){_W}+[0-9]{{4}}', 0), ''))", lambda: X.first_date("text"))
_per_row("fee_amounts", "documents", "doc_id", "array_to_string(regexp_extract_all(text, 'EUR ([0-9]+(?:[.,][0-9]{2})?)', 1), ',')", lambda: F.array_join(T.all_matches("text", "EUR ([0-9]+(?:[.,][0-9]{2})?)", 1), ","))
_per_row("deadline_dates", "documents", "doc_id", r"array_to_string(regexp_extract_all(text, '[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4})?', 0), ',')", lambda: F.array_join(T.all_matches("text", r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4})?"), ","))
_N = r"[0-9]{1,6}(?:[.,][0-9]{2})?"
_per_row("euro_amounts", "documents", "doc_id", f"array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '€{_W}*({_N})', 1), regexp_extract_all(text, '({_N}){_W}*€', 1)), regexp_extract_all(text, '(?i)({_N}){_W}*(?:EUR|Euro|euros)', 1))))[1:10], ',')", lambda: F.array_join(X.euro_amounts("text"), ","))
_has = lambda c, terms: "(" + " OR ".join(f"contains(lower({c}), '{t}')" for t in terms) + ")"
_sent = lambda terms, a, b: f"array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {trim_sql('x')}), lambda x: length(x) >= {a} AND length(x) <= {b} AND {_has('x', terms)})[1:8], lambda x: {ws_sql('x')}), ' | ')"
_per_row("key_actions", "documents", "doc_id", _sent(X.MODAL, 20, 200), lambda: F.array_join(X.key_actions("text"), " | "))
_per_row("eligibility_cues", "documents", "doc_id", _sent(X.ELIGIBLE, 25, 180), lambda: F.array_join(X.eligibility_cues("text"), " | "))
_per_row("program_facts", "documents", "doc_id", f"""concat_ws(',', CASE WHEN {_has('text', ('taught in english', 'english-taught', 'english language', 'b2 english', 'c1 english'))} THEN 'English' WHEN {_has('text', ('taught in german', 'german-taught', 'b2 german', 'c1 german'))} THEN 'German' END,
    CASE WHEN contains(lower(text), 'winter semester') AND contains(lower(text), 'summer semester') THEN 'winter+summer' WHEN {_has('text', ('winter semester', 'starts in winter'))} THEN 'winter' WHEN {_has('text', ('summer semester', 'starts in summer'))} THEN 'summer' END,
    nullif(regexp_extract(text, '([0-9]{{2,3}}){_W}*ECTS', 1), ''), CASE WHEN regexp_matches(lower(text), '[0-9]{_W}*semester') THEN regexp_extract(lower(text), '([0-9]){_W}*semester', 1) || ' semesters' END)""",
         lambda: F.concat_ws(",", *(X.program_facts("text")[f] for f in ("language", "intake", "ects", "duration"))))
_per_row("date_days", "documents", "doc_id", r"array_to_string(regexp_extract_all(text, '[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})?', 0), ',')", lambda: F.array_join(T.all_matches("text", r"[0-9]{1,2}\.[0-9]{1,2}\.(?:[0-9]{4}|[0-9]{2})?"), ","))
_DATES = (r"[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}", f"(?i)[0-9]{{1,2}}{_W}+(?:{X.MONTHS_EN}){_W}+[0-9]{{2,4}}", f"(?i)(?:{X.MONTHS_EN}){_W}+[0-9]{{1,2}},?{_W}+[0-9]{{2,4}}")
_per_row("extract_dates", "documents", "doc_id", "array_to_string(list_sort(list_distinct(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', 0)[1:5]" for p in _DATES[:2]) + f"), regexp_extract_all(text, '{_DATES[2]}', 0)[1:5])))[1:10], ',')", lambda: F.array_join(X.dates_and_deadlines("text"), ","))
_per_row("extract_contacts", "email_requests", "request_id", f"array_to_string(regexp_extract_all(email_text, '{X.EMAIL}', 0)[1:5], ',')", lambda: F.array_join(F.transform(F.filter(X.contacts("email_text"), lambda x: x["type"] == "email"), lambda x: x["value"]), ","))
_per_row("clean_contacts", "web_documents", "id", r"array_to_string(list_transform(list_filter(contacts, lambda c: CASE WHEN c.type = 'phone' THEN NOT regexp_matches(c.value, '^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}') AND length(regexp_replace(c.value, '[^0-9]', '', 'g')) BETWEEN 10 AND 15 WHEN c.type = 'email' THEN regexp_matches(lower(c.value), '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$') ELSE true END), lambda c: c.type || ':' || CASE WHEN c.type = 'email' THEN lower(c.value) ELSE trim(c.value) END), ',')",
         lambda: F.array_join(F.transform(X.clean_contacts(F.col("contacts")), lambda x: F.concat(x["type"], F.lit(":"), x["value"])), ","))
_per_row("extract_citations", "documents", "doc_id", r"array_to_string(list_filter(regexp_extract_all('[Doc ' || (doc_id % 3 + 1) || '] as said [Doc 2][Doc 2]', '\[Doc ([0-9]+)\]', 1), lambda x, i: list_position(regexp_extract_all('[Doc ' || (doc_id % 3 + 1) || '] as said [Doc 2][Doc 2]', '\[Doc ([0-9]+)\]', 1), x) = i), ',')",
         lambda: F.array_join(F.array_distinct(T.all_matches(F.concat(F.lit("[Doc "), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("] as said [Doc 2][Doc 2]")), r"\[Doc ([0-9]+)\]", 1)), ","))
_TERMS = ("semester ticket", "scholarships", "visa")
_per_row("best_snippet", "documents", "doc_id", ws_sql("substring(text, greatest(coalesce(list_min(list_filter([" + ", ".join(f"instr(lower(text), '{t}')" for t in _TERMS) + "], lambda p: p > 0)), 1) - 350, 1)::INTEGER, 1550)"), lambda: T.clean_whitespace(F.substring(F.col("text"), F.greatest(F.coalesce(F.array_min(F.filter(F.array(*(F.locate(t, F.lower("text")) for t in _TERMS)), lambda p: p > 0)), F.lit(1)) - 350, F.lit(1)), F.lit(1550))))
_per_row("append_disclaimer", "qa_pairs", "id", "CASE WHEN contains(answer, 'without guarantee') THEN answer ELSE answer || E'\\n\\nAll information without guarantee.' END", lambda: F.when(F.contains("answer", F.lit("without guarantee")), F.col("answer")).otherwise(F.concat("answer", F.lit("\n\nAll information without guarantee."))))
_per_row("clean_draft", "qa_pairs", "id", trim_sql("regexp_replace(regexp_replace(regexp_replace('**Note:** ' || answer || E'\\n\\n\\n\\n# End', '[*]{2}', '', 'g'), '(?m)^#+ ?', '', 'g'), '\\n{3,}', E'\\n\\n', 'g')"), lambda: T.trim_ws(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(F.lit("**Note:** "), "answer", F.lit("\n\n\n\n# End")), r"[*]{2}", ""), "(?m)^#+ ?", ""), r"\n{3,}", "\n\n")))
_per_row("evidence_query", "email_requests", "request_id", "concat_ws('. ', nullif(subject, ''), 'language ' || lang, 'top ' || top_k)", lambda: F.concat_ws(". ", F.nullif("subject", F.lit("")), F.concat(F.lit("language "), "lang"), F.concat(F.lit("top "), F.col("top_k").cast("string"))))
_per_row("required_min_chunks", "documents", "doc_id", "CASE WHEN length(text) >= 7000 THEN 10 WHEN length(text) >= 3500 THEN 6 WHEN length(text) >= 1800 THEN 4 WHEN length(text) >= 1000 THEN 3 ELSE 1 END", lambda: F.when(F.char_length("text") >= 7000, 10).when(F.char_length("text") >= 3500, 6).when(F.char_length("text") >= 1800, 4).when(F.char_length("text") >= 1000, 3).otherwise(1))


_NAMED = rf"(?i)(?:^|[^\w])([0-9]{{1,2}}(?:st|nd|rd|th)?{_W}+(?:{X.MONTHS_EN})|(?:{X.MONTHS_EN}){_W}+[0-9]{{1,2}}(?:st|nd|rd|th)?)"
_RANGES = rf"list_transform(list_concat(list_concat(regexp_extract_all(text, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.{_W}*[-–—]{_W}*[0-9]{{1,2}}\.[0-9]{{1,2}}\.', 0), regexp_extract_all(text, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.(?:[0-9]{{4}}|[0-9]{{2}})?', 0)), regexp_extract_all(text, '{_NAMED}', 1)), lambda x: {trim_sql('x')})"
_ranges = lambda sep: f"array_to_string(list_filter({_RANGES}, lambda x, i: list_position(list_transform({_RANGES}, lambda y: lower(y)), lower(x)) = i)[1:8], '{sep}')"
_HEAD = r"(?i)(?:Which documents|Required documents|Documents required|Application documents)[^\n]*\n?((?:[^\n]+\n?){0,15})"
_NAMING = f"length(x) BETWEEN 10 AND 120 AND {_has('x', X.DOCUMENT_TERMS)}"
_DOTTED = f"regexp_replace(x, '^[-•*]{_W}*', '')"
_SECTIONS = f"list_transform(regexp_extract_all(text, '{_HEAD}', 1), lambda s: list_transform(list_filter(list_transform(string_split(s, E'\\n'), lambda x: {trim_sql('x')}), lambda x: {_NAMING}), lambda x: {ws_sql(_DOTTED)}))"
_required = f"coalesce(array_to_string(list_filter({_SECTIONS}, lambda s: len(s) > 0)[1][1:10], '; '), '')"
_FACTS_OF = f"""concat_ws(', ', 'language=' || CASE WHEN {_has('text', ('taught in english', 'english-taught', 'english language', 'b2 english', 'c1 english'))} THEN 'English' WHEN {_has('text', ('taught in german', 'german-taught', 'b2 german', 'c1 german'))} THEN 'German' END,
    'intake=' || CASE WHEN contains(lower(text), 'winter semester') AND contains(lower(text), 'summer semester') THEN 'winter+summer' WHEN {_has('text', ('winter semester', 'starts in winter'))} THEN 'winter' WHEN {_has('text', ('summer semester', 'starts in summer'))} THEN 'summer' END,
    'ects=' || nullif(regexp_extract(text, '([0-9]{{2,3}}){_W}*ECTS', 1), ''), 'duration=' || CASE WHEN regexp_matches(lower(text), '[0-9]{_W}*semester') THEN regexp_extract(lower(text), '([0-9]){_W}*semester', 1) || ' semesters' END)"""
_euros = f"array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(text, '€{_W}*({_N})', 1), regexp_extract_all(text, '({_N}){_W}*€', 1)), regexp_extract_all(text, '(?i)({_N}){_W}*(?:EUR|Euro|euros)', 1))))[1:10], ', ')"


@query("date_ranges", f"SELECT doc_id, {_ranges(',')} AS v FROM documents")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges, days and named days, distinct but for case."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.date_ranges("text"), ",").alias("v"))


@query("signal_block", f"""
    WITH p AS (SELECT doc_id, object_type, nullif({_ranges(', ')}, '') AS dates, nullif({_sent(X.MODAL, 20, 200)}, '') AS actions, nullif({_required}, '') AS papers, nullif({_euros}, '') AS euros, nullif({_sent(X.ELIGIBLE, 25, 180)}, '') AS cues, nullif({_FACTS_OF}, '') AS facts
               FROM documents)
    SELECT doc_id, CASE object_type WHEN 'application_process' THEN concat_ws(E'\\n', 'Deadlines mentioned: ' || dates, 'Key actions: ' || actions, 'Required documents: ' || papers) WHEN 'fees_funding_rule' THEN concat_ws(E'\\n', 'Amounts mentioned: ' || euros || ' EUR', 'Eligibility cues: ' || cues)
      WHEN 'degree_program' THEN concat_ws(E'\\n', 'Program facts: ' || facts) ELSE '' END AS v FROM p""")  # fmt: skip
def signal_block(spark: SparkSession, d: str) -> DataFrame:
    """Lines of hints by the document's type."""
    return table(spark, d, "documents").select("doc_id", X.signal_block(F.col("object_type"), "text").alias("v"))


@query("required_documents", f"SELECT doc_id, {_required} AS v FROM documents")
def required_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.required_documents("text"), "; ").alias("v"))


_FOUND = "list_sort(list_distinct(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', 0)[1:5]" for p in _DATES[:2]) + f"), regexp_extract_all(text, '{_DATES[2]}', 0)[1:5])))[1:10]"


@query("clean_dates", f"SELECT doc_id, array_to_string(list_filter(list_transform({_FOUND}, lambda x: {trim_sql('x')}), lambda x: regexp_matches(x, '[0-9]')), ',') AS v FROM documents")
def clean_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates found in the texts, cleaned."""
    return table(spark, d, "documents").select("doc_id", F.array_join(X.clean_dates(X.dates_and_deadlines("text")), ",").alias("v"))


@query("clean_pages", r"""
    SELECT id, replace(replace(replace(replace(title, 'Ã¤', 'ä'), 'Ã¼', 'ü'), 'â€™', ''''), 'Â', '') AS title,
      array_to_string(list_transform(list_filter(contacts, lambda c: CASE WHEN c.type = 'phone' THEN NOT regexp_matches(c.value, '^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4}') AND length(regexp_replace(c.value, '[^0-9]', '', 'g')) BETWEEN 10 AND 15
        WHEN c.type = 'email' THEN regexp_matches(lower(c.value), '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$') ELSE true END), lambda c: c.type || ':' || CASE WHEN c.type = 'email' THEN lower(c.value) ELSE trim(c.value) END), ',') AS contacts FROM web_documents""")  # fmt: skip
def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    """Web documents with repaired titles and cleaned contacts."""
    shown = F.array_join(F.transform(X.clean_contacts(F.col("contacts")), lambda x: F.concat(x["type"], F.lit(":"), x["value"])), ",")
    return table(spark, d, "web_documents").select("id", T.fix_encoding("title").alias("title"), shown.alias("contacts"))


@query("page_program_facts", f"""
    WITH p AS (SELECT snapshot_id, content.full_text AS text FROM overview_pages WHERE content.full_text IS NOT NULL) SELECT snapshot_id, {_FACTS_OF} AS v FROM p""")  # fmt: skip
def page_program_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of a programme in the text of pages."""
    f = X.program_facts("text")
    shown = F.concat_ws(", ", *(F.when(f[n].isNotNull(), F.concat(F.lit(f"{n}="), f[n])) for n in ("language", "intake", "ects", "duration")))
    return table(spark, d, "overview_pages").where("content.full_text IS NOT NULL").select("snapshot_id", F.col("content.full_text").alias("text")).select("snapshot_id", shown.alias("v"))

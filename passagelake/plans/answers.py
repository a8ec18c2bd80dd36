"""Embedding, evidence selection, citations, prompts and quality as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators.embed import embed
from ..operators.rules import exact_matches
from ..operators.upsert import numbered
from ..session import table
from .registry import query


@query("embed", """
    SELECT id, 768 AS dims, 'hashing-768' AS embedding_model, CASE WHEN regexp_matches(chunk_text, '[\\p{L}\\p{N}_]') THEN 1.0::DOUBLE ELSE 0 END AS squared_norm FROM chunks WHERE chunk_text IS NOT NULL AND md5(chunk_text) NOT IN (SELECT md5(text) FROM web_chunks WHERE text IS NOT NULL)""")  # fmt: skip
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """New passages embedded: those whose text is already stored never reach the model."""
    c = table(spark, d, "chunks")
    known = table(spark, d, "web_chunks").select(F.md5("text").alias("h"))
    fresh = c.select("id", "chunk_text", F.md5("chunk_text").alias("h")).where("chunk_text IS NOT NULL").join(known, "h", "left_anti")
    return embed(fresh, ["id"], "chunk_text").select("id", F.size("embedding").alias("dims"), "embedding_model", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("squared_norm"))


_ALIAS, _OTHER = "['soziale', 'social']", "['maritime']"
_SCORE = f"""
    (len(list_filter({_ALIAS}, lambda a: contains(lower(coalesce(url, '')), a))) * 6 + len(list_filter({_ALIAS}, lambda a: contains(lower(coalesce(title, '')), a))) * 5 + len(list_filter({_ALIAS}, lambda a: contains(lower(coalesce(raw_json, '')), a))) * 4
     + CASE WHEN starts_with(lower(coalesce(url, '')), 'https://www.birkenhorst.test/en/') THEN 10 ELSE 0 END - CASE WHEN object_type = 'special_category' THEN 5 ELSE 0 END - CASE WHEN len(list_filter({_OTHER}, lambda o: contains(lower(coalesce(title, '')), o) OR contains(lower(coalesce(url, '')), o))) > 0 THEN 6 ELSE 0 END)::INTEGER"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "site_objects")
    s = A.programme_score(F.col("title"), F.col("url"), F.col("raw_json"), F.array(F.lit("soziale"), F.lit("social")), F.array(F.lit("maritime")), F.col("object_type") == "special_category", F.lit("https://www.birkenhorst.test/en/"))
    return o.select("id", "object_type", "title", s.alias("score"))


@query("doc_programme_score", f"SELECT id, {_SCORE} AS score FROM site_objects")
def doc_programme_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("id", "score")


@query("programme_doc_filter", f"""
    WITH s AS (SELECT id, object_type, {_SCORE} AS score FROM site_objects),
    p AS (SELECT *, sum(CASE WHEN score >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY object_type) AS strong, row_number() OVER (PARTITION BY object_type ORDER BY CASE WHEN score >= 3 THEN 1 ELSE 0 END DESC, id) AS position FROM s)
    SELECT object_type, id, score, position::INTEGER AS position FROM p WHERE position <= greatest(strong, 5)""")  # fmt: skip
def programme_doc_filter(spark: SparkSession, d: str) -> DataFrame:
    """Documents that fit a programme, filled up to five of each type."""
    return A.select_evidence(_scored(spark, d), "object_type", "score", "id").select("object_type", "id", "score", "position")


@query("best_citation", f"""
    WITH s AS (SELECT object_type, title, {_SCORE} AS score, row_number() OVER (PARTITION BY object_type ORDER BY id) AS position FROM site_objects),
    b AS (SELECT object_type, min((-score, position)) FILTER (WHERE score >= 3) AS s, min(position) FILTER (WHERE contains(lower(title), 'fee')) AS k FROM s GROUP BY 1)
    SELECT object_type, coalesce(s[2], k, 1)::INTEGER AS citation FROM b""")  # fmt: skip
def best_citation(spark: SparkSession, d: str) -> DataFrame:
    """The document of each type to cite."""
    return A.best_citation(numbered(_scored(spark, d), "object_type", "id", "position"), "object_type", "score", "position", F.contains(F.lower("title"), F.lit("fee")))


@query("concat_official", """
    SELECT 'official' AS origin, 0 AS ordinal, CAST(id AS VARCHAR) AS key FROM site_objects WHERE object_type = 'fees_funding_rule'
    UNION ALL SELECT 'retrieved', 1, id FROM web_documents WHERE contains(lower(title), 'fees')""")  # fmt: skip
def concat_official(spark: SparkSession, d: str) -> DataFrame:
    """Official documents before retrieved ones; the ordinal keeps the order."""
    a = table(spark, d, "site_objects").where("object_type = 'fees_funding_rule'").select(F.lit("official").alias("origin"), F.lit(0).alias("ordinal"), F.col("id").cast("string").alias("key"))
    return a.unionAll(table(spark, d, "web_documents").where(F.contains(F.lower("title"), F.lit("fees"))).select(F.lit("retrieved"), F.lit(1), "id"))


_TOPIC_LINKS = {"fees": ("https://www.example.org/fees", "https://www.example.org/costs"), "housing": ("https://www.example.org/housing",)}


@query("reference_links", """
    WITH w AS (SELECT id, CASE WHEN links[1].url IS NULL THEN [] ELSE ['[Doc 1] ' || links[1].url] END AS l, list_filter([CASE WHEN contains(lower(title), 'fee') THEN 'fees' END, CASE WHEN contains(lower(title), 'dorm') OR contains(lower(title), 'wohnheim') THEN 'housing' END], lambda x: x IS NOT NULL) AS t FROM web_documents)
    SELECT id, array_to_string(list_concat(list_concat(l, CASE WHEN list_contains(t, 'fees') THEN ['- https://www.example.org/fees', '- https://www.example.org/costs'] ELSE [] END), CASE WHEN list_contains(t, 'housing') THEN ['- https://www.example.org/housing'] ELSE [] END), E'\\n') AS v FROM w""")  # fmt: skip
def reference_links(spark: SparkSession, d: str) -> DataFrame:
    """Reference lines of the documents that are cited and have a URL, and the links of their topics."""
    urls = F.slice(F.coalesce(F.transform("links", lambda x: x["url"]), F.array().cast("array<string>")), 1, 1)
    cited = F.filter(F.split(A.reference_lines(F.array(F.lit(1), F.lit(9), F.lit(1)), urls), "\n"), lambda x: x != "")
    low = F.lower("title")
    topics = F.array_compact(F.array(F.when(F.contains(low, F.lit("fee")), "fees"), F.when(F.contains(low, F.lit("dorm")) | F.contains(low, F.lit("wohnheim")), "housing")))
    return table(spark, d, "web_documents").select("id", F.array_join(A.with_topic_links(cited, topics, _TOPIC_LINKS), "\n").alias("v"))


@query("renumber_citations", f"""
    WITH f AS (SELECT id, row_num, coalesce(tags[1], 'this') AS t, question FROM qa_pairs WHERE row_num IS NOT NULL AND question IS NOT NULL AND NOT contains(question, '[Doc'))
    SELECT id, md5('See ' || CASE row_num % 4 + 1 WHEN 3 THEN '[Doc 1]' WHEN 1 THEN '[Doc 2]' ELSE '' END || ' on ' || t || ', ' || question || ' ' || CASE row_num % 3 + 1 WHEN 3 THEN '[Doc 1]' WHEN 1 THEN '[Doc 2]' ELSE '' END || '.') AS v FROM f""")  # fmt: skip
def renumber_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of drafts made of each question, after the sources are put in a new order."""
    q = table(spark, d, "qa_pairs").where("row_num IS NOT NULL AND question IS NOT NULL").where(~F.contains("question", F.lit("[Doc")))
    cite = lambda n: F.concat(F.lit("[Doc "), (F.col("row_num") % n + 1).cast("string"), F.lit("]"))
    draft = F.concat(F.lit("See "), cite(4), F.lit(" on "), F.coalesce(F.get("tags", F.lit(0)), F.lit("this")), F.lit(", "), "question", F.lit(" "), cite(3), F.lit("."))
    return q.select("id", F.md5(A.renumber_citations(draft, F.array(F.lit(3), F.lit(1)))).alias("v"))


_Q_PARTS = {
    "topics": (20.0, "least(coalesce(len(tags), 0) / 2.0::DOUBLE, 1)"),
    "length": (25.0, "least(n / 200.0::DOUBLE, 1)"),
    "numbers": (20.0, "CASE WHEN regexp_matches(answer, '[0-9]') THEN 1.0::DOUBLE ELSE 0 END"),
    "overlap": (15.0, "least(len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[a-zäöüß]{5,}')), list_distinct(regexp_extract_all(lower(answer), '[a-zäöüß]{5,}')))) / 3.0::DOUBLE, 1)"),
    "sentences": (10.0, "CASE WHEN regexp_matches(trim(answer), '[.!?]$') THEN 1.0::DOUBLE ELSE 0 END"),
    "reference": (5.0, "CASE WHEN regexp_matches(answer, '@|https?://') THEN 1.0::DOUBLE ELSE 0 END"),
    "form": (5.0, "CASE WHEN regexp_matches(answer, '^[A-ZÄÖÜ]') THEN 1.0::DOUBLE ELSE 0 END"),
}
_Q_CAPS = ((60.0, "n < 40"), (70.0, "contains(lower(answer), 'cannot')"), (75.0, "NOT regexp_matches(trim(answer), '[.!?]$')"), (80.0, "coalesce(len(tags), 0) = 0"))


@query("quality_score", f"""
    WITH p AS (SELECT *, length(answer) AS n FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL), t AS (SELECT *, {' + '.join(f'{sql} * {w}::DOUBLE' for w, sql in _Q_PARTS.values())} AS total FROM p),
    s AS (SELECT id, round(least(total, {', '.join(f'CASE WHEN {cond} THEN {cap}::DOUBLE ELSE 100 END' for cap, cond in _Q_CAPS)}), 2) AS score FROM t)
    SELECT id, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 70 THEN 'mostly_good' WHEN score >= 50 THEN 'partial' ELSE 'review' END AS label FROM s""")  # fmt: skip
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """A score of answers from seven weighted parts under four caps, and its label."""
    n, t, answer = F.char_length("answer"), F.coalesce(F.size("tags"), F.lit(0)), F.col("answer")
    has = lambda p: F.regexp_like(answer, F.lit(p)).cast("double")
    long = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zäöüß]{5,}"), F.lit(0)))
    ends = F.regexp_like(F.trim(answer), F.lit("[.!?]$"))
    parts = {
        "topics": (F.least(t / 2.0, F.lit(1.0)), 20.0), "length": (F.least(n / 200.0, F.lit(1.0)), 25.0), "numbers": (has("[0-9]"), 20.0), "overlap": (F.least(F.size(F.array_intersect(long(F.col("question")), long(answer))) / 3.0, F.lit(1.0)), 15.0),
        "sentences": (ends.cast("double"), 10.0), "reference": (has("@|https?://"), 5.0), "form": (has("^[A-ZÄÖÜ]"), 5.0)}
    caps = [(n < 40, 60.0), (F.contains(F.lower(answer), F.lit("cannot")), 70.0), (~ends, 75.0), (t == 0, 80.0)]
    return table(spark, d, "qa_pairs").where("question IS NOT NULL AND answer IS NOT NULL").select("id", A.weighted_quality(parts, caps).alias("q")).select("id", "q.score", "q.label")


#: Example patterns of what a mail says of its sender: group 1 is the value.
CONTEXT = {
    "addressed": r"(?m)^(?:Hallo|Hi|Dear) ([A-Z][a-z]+),",
    "signed": r"(?m)^(?:Best regards|Kind regards|Best wishes|Viele Grüße|Mit freundlichen Grüßen),?[ ]*\r?\n([A-ZÄÖÜ][^\r\n,]{1,60})",
    "semester": r"((?:[Ww]inter|[Ss]ummer|Sommer)[ ]?semester [0-9]{2,4}(?:/[0-9]{2})?)",
    "student_id": r"(?:[Mm]atrikelnummer|[Ss]tudent (?:ID|number)|Matr\.-Nr\.)[ :]*(?:is |ist |lautet )?([A-Za-z]?[0-9]{5,9})",
    "deadline": r"(?:before|until|by|bis zum|Bis zum) ([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})",
    "room": r"(?:room|Raum) ([A-Z] [0-9]{1,4})",
    "module": r"(?:module|Modul) ([A-Z][0-9]{1,3}\.[0-9]{1,2})",
    "programme": r"(?:apply for|study|studiere|für|für den Studiengang) ([A-Z][a-zäöü]+ [A-Z][a-zäöü]+(?: [A-Z][a-zäöü]+)?)",
}


@query("email_context", f"""
    SELECT request_id, coalesce(lang, CASE WHEN regexp_matches(lower(email_text), '\\b(und|nicht|der|die|das)\\b') THEN 'de' ELSE 'en' END) AS language,
      CASE WHEN contains(lower(email_text), 'master') THEN 'master' WHEN contains(lower(email_text), 'bachelor') THEN 'bachelor' END AS degree,
      {", ".join(f"nullif(regexp_extract(email_text, '{p}', 1), '') AS {k}" for k, p in CONTEXT.items())} FROM email_requests""")  # fmt: skip
def email_context(spark: SparkSession, d: str) -> DataFrame:
    """What a mail says of itself and its sender, one column a pattern."""
    got = lambda p: F.nullif(F.regexp_extract("email_text", p, 1), F.lit(""))
    low = F.lower("email_text")
    lang = F.coalesce("lang", F.when(F.regexp_like(low, F.lit(r"\b(und|nicht|der|die|das)\b")), "de").otherwise("en"))
    degree = F.when(F.contains(low, F.lit("master")), "master").when(F.contains(low, F.lit("bachelor")), "bachelor")
    return table(spark, d, "email_requests").select("request_id", lang.alias("language"), degree.alias("degree"), *(got(p).alias(k) for k, p in CONTEXT.items()))


_PROFILE = {"language": "lang", "thread": "thread_id", **{k: f"nullif(regexp_extract(email_text, '{p}', 1), '')" for k, p in CONTEXT.items()}}


@query("draft_prompt", f"""
    SELECT request_id, md5(concat_ws(E'\\n\\n', nullif(concat_ws(E'\\n', {", ".join(f"'{k}: ' || {v}" for k, v in _PROFILE.items())}), ''), 'Topics: ' || coalesce(subject, 'none'), '[Doc 1] ' || left(email_text, 1400), 'Cite every statement.')) AS prompt_md5 FROM email_requests WHERE lang IS NOT NULL""")  # fmt: skip
def draft_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The prompt for a generator: what the mail says of its sender, topics, evidence, rules."""
    m = table(spark, d, "email_requests").where("lang IS NOT NULL")
    known = {"language": F.col("lang"), "thread": F.col("thread_id"), **{k: F.nullif(F.regexp_extract("email_text", p, 1), F.lit("")) for k, p in CONTEXT.items()}}
    p = A.prompt(known, F.array(F.coalesce("subject", F.lit("none"))), F.array("email_text"), "Cite every statement.")
    return m.select("request_id", F.md5(p).alias("prompt_md5"))


@query("greeting", """
    SELECT request_id, CASE WHEN lang = 'de' THEN 'Guten Tag' ELSE 'Hello' END || coalesce(' ' || nullif(regexp_extract(student_email, '^([a-z]+)[._+@]', 1), ''), '') || ',' AS v FROM email_requests""")  # fmt: skip
def greeting(spark: SparkSession, d: str) -> DataFrame:
    name = F.coalesce(F.concat(F.lit(" "), F.nullif(F.regexp_extract("student_email", "^([a-z]+)[._+@]", 1), F.lit(""))), F.lit(""))
    return table(spark, d, "email_requests").select("request_id", F.concat(F.when(F.col("lang") == "de", "Guten Tag").otherwise("Hello"), name, F.lit(",")).alias("v"))


@query("recommendations", """
    WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE title IS NULL) AS untitled, count(*) FILTER (WHERE object_type IS NULL) AS untyped, count(*) FILTER (WHERE lang IS NULL) AS no_lang, count(*) FILTER (WHERE length(text) < 200) AS thin,
      count(DISTINCT md5(text)) AS texts, max(updated_at) AS newest FROM documents GROUP BY 1)
    SELECT source, 'fill titles' AS advice, 1 AS priority FROM r WHERE untitled > 0.05 * n UNION ALL SELECT source, 'classify', 2 FROM r WHERE untyped > 0.05 * n UNION ALL SELECT source, 'too few documents', 3 FROM r WHERE n < 20
    UNION ALL SELECT source, 'detect languages', 4 FROM r WHERE no_lang > 0.02 * n UNION ALL SELECT source, 'enrich thin texts', 5 FROM r WHERE thin > 0.1 * n UNION ALL SELECT source, 'drop copies', 6 FROM r WHERE texts < n UNION ALL SELECT source, 'fetch again', 7 FROM r WHERE newest < TIMESTAMP '2025-06-01'""")  # fmt: skip
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Rules over one small aggregate a source, by priority."""
    t = table(spark, d, "documents")
    copies = t.groupBy("source", F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("c")).groupBy("source").agg(F.count(F.lit(1)).alias("texts"))
    part = lambda c: F.count_if(c)
    r = t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), part(F.col("title").isNull()).alias("untitled"), part(F.col("object_type").isNull()).alias("untyped"), part(F.col("lang").isNull()).alias("no_lang"), part(F.char_length("text") < 200).alias("thin"), F.max("updated_at").alias("newest")).join(copies, "source")
    n = F.col("n")
    known = [
        (F.col("untitled") > 0.05 * n, "fill titles"), (F.col("untyped") > 0.05 * n, "classify"), (n < 20, "too few documents"), (F.col("no_lang") > 0.02 * n, "detect languages"),
        (F.col("thin") > 0.1 * n, "enrich thin texts"), (F.col("texts") < n, "drop copies"), (F.col("newest") < F.lit("2025-06-01").cast("timestamp"), "fetch again")]
    rules = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(x).alias("advice"), F.lit(p).alias("priority"))) for p, (c, x) in enumerate(known, 1))))
    return r.select("source", F.inline(rules)).orderBy("priority", "source")


_KNOWN = "CASE WHEN json_valid(raw_json) THEN raw_json->>'$.{0}' END"


@query("object_answer", f"""
    SELECT id, concat_ws(E'\\n', 'Title: ' || title, 'Type: ' || object_type, CASE WHEN object_type = 'degree_program' THEN concat_ws(E'\\n', 'Degree: ' || nullif({_KNOWN.format('program_info.degree_type')}, ''), 'Language: ' || nullif({_KNOWN.format('program_info.language')}, '')) END,
      CASE WHEN object_type = 'language_proof_rule' THEN 'Test: ' || title END, CASE WHEN object_type = 'fees_funding_rule' THEN 'Kind: ' || CASE WHEN contains(lower(title), 'scholarship') THEN 'funding' ELSE 'fee' END END, 'More: ' || url) AS v
    FROM (SELECT * FROM site_objects WHERE object_type <> 'degree_program' OR json_valid(raw_json))""")  # fmt: skip
def object_answer(spark: SparkSession, d: str) -> DataFrame:
    """An object in lines, with those of its type; lines without a value are left out."""
    o = table(spark, d, "site_objects").where((F.col("object_type") != "degree_program") | F.expr("try_parse_json(raw_json) IS NOT NULL"))
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c)
    of = lambda kind, c: F.when(F.col("object_type") == kind, c)
    info = lambda f: F.nullif(F.get_json_object("raw_json", f"$.program_info.{f}"), F.lit(""))
    degree = of("degree_program", F.concat_ws("\n", line("Degree", info("degree_type")), line("Language", info("language"))))
    fee = of("fees_funding_rule", line("Kind", F.when(F.contains(F.lower("title"), F.lit("scholarship")), "funding").otherwise("fee")))
    return o.select("id", F.concat_ws("\n", line("Title", F.col("title")), line("Type", F.col("object_type")), degree, of("language_proof_rule", line("Test", F.col("title"))), fee, line("More", F.col("url"))).alias("v"))


# --- conditional texts -------------------------------------------------------------------------------------------
@query("guarded_rewrite", """
    SELECT id, CASE WHEN list_has_any(coalesce(tags, []), ['fees', 'exams']) THEN regexp_replace(answer, '(?i)EUR ([0-9]+)', '\\1 euros', 'g') ELSE answer END AS v FROM qa_pairs""")  # fmt: skip
def guarded_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Answers reworded where their topics ask for it."""
    return table(spark, d, "qa_pairs").select("id", A.guarded_rewrite(F.col("answer"), F.col("tags"), ("fees", "exams"), "(?i)EUR ([0-9]+)", "$1 euros").alias("v"))


_NOTES = {"very_low": "\n\nLittle was found on this; please verify it.", "low": "\n\nThis may not be complete."}


@query("low_confidence_note", """
    WITH c AS (SELECT id, answer, length(answer) / 400.0::DOUBLE AS c FROM qa_pairs)
    SELECT id, answer || CASE WHEN c < 0.3 THEN E'\\n\\nLittle was found on this; please verify it.' WHEN c < 0.5 THEN E'\\n\\nThis may not be complete.' ELSE '' END AS v FROM c""")  # fmt: skip
def low_confidence_note(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a note where confidence (here by length) is low."""
    c = F.char_length("answer") / 400.0
    level = F.when(c < 0.3, "very_low").when(c < 0.5, "low").otherwise("medium")
    return table(spark, d, "qa_pairs").select("id", A.with_note(F.col("answer"), level, _NOTES).alias("v"))


@query("followup_message", """
    SELECT request_id, E'This message follows an earlier one.\\n\\nMessage preview:\\n' || left(email_text, 500) AS v FROM email_requests WHERE regexp_matches(lower(email_text), 'again|noch einmal|follow')""")  # fmt: skip
def followup_message(spark: SparkSession, d: str) -> DataFrame:
    """A note with the first 500 characters of mails that follow earlier ones."""
    m = table(spark, d, "email_requests").where(F.regexp_like(F.lower("email_text"), F.lit("again|noch einmal|follow")))
    return m.select("request_id", F.concat(F.lit("This message follows an earlier one.\n\nMessage preview:\n"), F.substring("email_text", 1, 500)).alias("v"))


@query("prompt_guidance", """
    SELECT id, concat_ws(E'\\n', CASE WHEN contains(lower(question), 'fee') OR contains(lower(question), 'gebühr') THEN 'Give amounts with their currency.' END, CASE WHEN regexp_matches(lower(question), 'deadline|frist|until|bis wann') THEN 'Give dates in full.' END,
      CASE WHEN list_contains(coalesce(tags, []), 'exams') THEN 'Name the module.' END) AS v FROM qa_pairs WHERE question IS NOT NULL""")  # fmt: skip
def prompt_guidance(spark: SparkSession, d: str) -> DataFrame:
    """Lines of guidance for a generator, each under its condition."""
    low = F.lower("question")
    rules = [
        (F.contains(low, F.lit("fee")) | F.contains(low, F.lit("gebühr")), "Give amounts with their currency."),
        (F.regexp_like(low, F.lit("deadline|frist|until|bis wann")), "Give dates in full."),
        (F.coalesce(F.array_contains("tags", "exams"), F.lit(False)), "Name the module."),
    ]
    return table(spark, d, "qa_pairs").where("question IS NOT NULL").select("id", A.lines_where(rules).alias("v"))


@query("topic_ordering", """
    WITH t AS (SELECT id, list_transform(tags, lambda x: CASE WHEN x = 'thesis' THEN 'exams' ELSE x END) AS t FROM qa_pairs WHERE tags IS NOT NULL),
    k AS (SELECT id, CASE WHEN list_has_any(t, ['fees', 'housing']) THEN list_filter(t, lambda x: x <> 'library') ELSE t END AS k FROM t),
    o AS (SELECT id, list_filter(['exams', 'fees', 'housing', 'visa', 'library', 'sports'], lambda x: list_contains(k, x))[1:3] AS o FROM k)
    SELECT id, CASE WHEN len(o) = 0 THEN 'general' ELSE array_to_string(o, ',') END AS topics FROM o""")  # fmt: skip
def topic_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Topics merged, made unneeded by others, ordered and cut."""
    t = A.ordered_topics(F.col("tags"), ("exams", "fees", "housing", "visa", "library", "sports"), {"thesis": "exams"}, [(("fees", "housing"), "library")], 3, "general")
    return table(spark, d, "qa_pairs").where("tags IS NOT NULL").select("id", F.array_join(t, ",").alias("topics"))


@query("programme_context", """
    WITH p AS (SELECT arg_min(url, id) AS url, arg_min(CASE WHEN json_valid(raw_json) THEN raw_json->>'$.program_info.language' END, id) AS language, min(id) AS ord, title AS name FROM site_objects WHERE object_type = 'degree_program' AND title IS NOT NULL GROUP BY title),
    n AS (SELECT *, trim(regexp_replace(lower(replace(name, '&', ' and ')), '[^a-z0-9äöüß]+', ' ', 'g')) AS a FROM p), t AS (SELECT request_id, email_text, ' ' || trim(regexp_replace(lower(replace(email_text, '&', ' and ')), '[^a-z0-9äöüß]+', ' ', 'g')) || ' ' AS t FROM email_requests),
    h AS (SELECT t.request_id, t.email_text, n.*, CASE WHEN length(n.a) > 4 THEN 1.0 ELSE 0.92 END AS score FROM t JOIN n ON contains(t.t, ' ' || n.a || ' ') WHERE n.a <> ''),
    b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) = 1)
    SELECT request_id, concat_ws(E'\\n', 'Known of the programme:', '- Name: ' || name, '- Degree in the mail: ' || CASE WHEN contains(lower(email_text), 'master') THEN 'master' WHEN contains(lower(email_text), 'bachelor') THEN 'bachelor' END, '- Language: ' || nullif(language, ''), '- Page: ' || nullif(url, ''),
      'Use this name.') AS block, '- Programme page (' || name || '): ' || url AS reference, printf('%.2f', score) AS match_score FROM b""")  # fmt: skip
def programme_context(spark: SparkSession, d: str) -> DataFrame:
    """For each mail that names a programme what is known of it, as a block for a prompt, a reference line and the match's score."""
    o = table(spark, d, "site_objects").where("object_type = 'degree_program' AND title IS NOT NULL")
    language = F.when(F.expr("try_parse_json(raw_json) IS NOT NULL"), F.get_json_object("raw_json", "$.program_info.language"))
    first = o.groupBy(F.col("title").alias("name")).agg(F.min("id").alias("ord"), F.min_by(F.struct(F.col("url").alias("url"), language.alias("language")), "id").alias("x"))
    mails = table(spark, d, "email_requests").select("request_id", "email_text")
    best = exact_matches(mails, first.select("name", F.col("name").alias("alias"), "ord"), "request_id", "email_text")
    j = best.join(first.select("name", "x.url", "x.language"), "name").join(mails, "request_id")
    low = F.lower("email_text")
    degree = F.when(F.contains(low, F.lit("master")), "master").when(F.contains(low, F.lit("bachelor")), "bachelor")
    text = A.block("Known of the programme:", {"Name": F.col("name"), "Degree in the mail": degree, "Language": F.col("language"), "Page": F.col("url")}, "Use this name.")
    return j.select("request_id", text.alias("block"), F.concat(F.lit("- Programme page ("), "name", F.lit("): "), "url").alias("reference"), F.format_string("%.2f", "score").alias("match_score"))


#: Example phrases that a draft should not have; a caller brings its own.
PHRASES = ("without guarantee", "free of charge", "as far as known", "in the sources given", "according to the passages", "no information available", "to be confirmed", "we are not sure", "ask again later", "as mentioned above", "see the attachment", "cannot help")


@query("bad_phrase", "SELECT id, array_to_string(list_filter([" + ", ".join(f"'{p}'" for p in PHRASES) + "], lambda p: contains(regexp_replace(lower(answer), '(?s)\\s*please note:.*$', ''), p)), '; ') AS phrases FROM qa_pairs WHERE answer IS NOT NULL")
def bad_phrase(spark: SparkSession, d: str) -> DataFrame:
    """The phrases of a table that an answer has, but for those in a disclaimer at its end."""
    return table(spark, d, "qa_pairs").where("answer IS NOT NULL").select("id", F.array_join(A.bad_phrases(F.col("answer"), PHRASES, "(?i)please note:"), "; ").alias("phrases"))

"""Labels, matches and checks: rule tables over pages, questions, mails and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import rules as L
from ..session import table
from .registry import query
from .texts import match_sql

_PATH = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_has = lambda c, *ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"


_CLASS = " ".join(f"WHEN {' AND '.join(_has('p', *parts) for parts in groups)} THEN '{kind}:{sure}'" for groups, kind, sure in L.PAGE_RULES)


@query("classify_pages", f"""
    WITH p AS (SELECT id, {_PATH} AS p FROM site_objects),
    c AS (SELECT id, CASE WHEN NOT starts_with(p, '{L.PAGE_SCOPE}') THEN '{':'.join(L.OUT_OF_SCOPE)}' {_CLASS} ELSE '{':'.join(L.NO_RULE)}' END AS c FROM p)
    SELECT id, string_split(c, ':')[1] AS page_class, string_split(c, ':')[2] AS confidence FROM c""")  # fmt: skip
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_objects").select("id", L.classify_page(F.coalesce("url", F.lit(""))).alias("c")).select("id", "c.page_class", "c.confidence")


@query("build_stats", "SELECT object_type, CASE WHEN raw_json IS NULL THEN 'missing' WHEN json_valid(raw_json) THEN 'built' ELSE 'failed' END AS status, count(*) AS n FROM site_objects GROUP BY 1, 2")
def build_stats(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("raw_json").isNull(), "missing").when(F.expr("try_parse_json(raw_json) IS NOT NULL"), "built").otherwise("failed")
    return table(spark, d, "site_objects").groupBy("object_type", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))



@query("suggest_object_id", """
    WITH s AS (SELECT id, object_type, title, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(title, '\\(.*?\\)', '', 'g')), '[^a-z0-9]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS core FROM site_objects WHERE title IS NOT NULL)
    SELECT id, CASE WHEN object_type = 'degree_program' THEN CASE WHEN contains(lower(title), 'master') THEN 'msc' WHEN contains(lower(title), 'bachelor') THEN 'bsc' ELSE 'program' END WHEN object_type = 'curriculum_page' THEN 'curriculum' ELSE object_type END || '-' || core AS object_id FROM s""")  # fmt: skip
def suggest_object_id(spark: SparkSession, d: str) -> DataFrame:
    """An id from class and title."""
    core = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("title", r"\(.*?\)", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    low = F.lower("title")
    prefix = F.when(F.col("object_type") == "degree_program", F.when(F.contains(low, F.lit("master")), "msc").when(F.contains(low, F.lit("bachelor")), "bsc").otherwise("program")).when(F.col("object_type") == "curriculum_page", "curriculum").otherwise(F.col("object_type"))
    return table(spark, d, "site_objects").where("title IS NOT NULL").select("id", F.concat(prefix, F.lit("-"), core).alias("object_id"))


#: Example rules in the words of the data; callers bring their own.
TOPICS: dict[str, tuple[str, ...]] = {
    "application": ("apply|application|bewerb", "admission|zulassung", "enrol|immatrikul"),
    "exams": ("exam|prüfung", "thesis|abschlussarbeit"),
    "fees": ("eur [0-9]|euro|fee ", "gebühr", "contribution"),
    "housing": ("dormitor|wohnheim", "housing"),
    "language": ("language|sprach", "placement test|einstufung"),
    "study": ("module? [a-z][0-9]", "credits|leistungspunkt", "semester"),
    "support": ("childcare|kinderbetreuung", "barrier-free|barrierefrei", "scholarship|stipend"),
}
TOPIC_ORDER = ("application", "fees", "exams", "study", "language", "housing", "support")


def _tags_sql(c: str, default: str) -> str:
    hits = ", ".join(f"CASE WHEN regexp_matches(lower({c}), '{'|'.join(f'(?:{p})' for p in ps)}') THEN '{k}' END" for k, ps in sorted(TOPICS.items()))
    return f"coalesce(nullif(array_to_string(list_sort(list_filter([{hits}], lambda x: x IS NOT NULL)), '; '), ''), '{default}')"


@query("tag_pages", f"SELECT snapshot_id, {_tags_sql('content.full_text', 'general-info')} AS tags FROM overview_pages WHERE content.full_text IS NOT NULL")
def tag_pages(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "overview_pages").where("content.full_text IS NOT NULL")
    return p.select("snapshot_id", F.array_join(L.labels_by_rules(F.col("content.full_text"), TOPICS, "general-info"), "; ").alias("tags"))


@query("tag_qa", f"SELECT id, {_tags_sql(chr(99) + 'oncat(question, chr(32), answer)', 'general-inquiry')} AS tags FROM qa_pairs")
def tag_qa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_pairs").select("id", F.array_join(L.labels_by_rules(F.concat("question", F.lit(" "), "answer"), TOPICS, "general-inquiry"), "; ").alias("tags"))


_ORDER_SQL = "[" + ", ".join(f"'{t}'" for t in TOPIC_ORDER) + "]"


@query("topic_detection", f"""
    WITH t AS (SELECT request_id, string_split({_tags_sql('email_text', 'none')}, '; ') AS got FROM email_requests)
    SELECT request_id, coalesce(nullif(array_to_string(list_filter({_ORDER_SQL}, lambda x: list_contains(got, x))[1:4], ','), ''), 'application') AS topics FROM t""")  # fmt: skip
def topic_detection(spark: SparkSession, d: str) -> DataFrame:
    """Topics of a mail in order of priority, at most four; application if there is none."""
    got = L.labels_by_rules(F.col("email_text"), TOPICS)
    ordered = F.slice(F.filter(F.array(*map(F.lit, TOPIC_ORDER)), lambda x: F.array_contains(got, x)), 1, 4)
    return table(spark, d, "email_requests").where("email_text IS NOT NULL").select("request_id", F.coalesce(F.nullif(F.array_join(ordered, ","), F.lit("")), F.lit("application")).alias("topics"))


@query("infer_types", """
    WITH u AS (SELECT id, coalesce(lower(title), '') AS t FROM web_documents)
    SELECT id, array_to_string(list_filter([CASE WHEN contains(t, 'application') OR contains(t, 'enrol') THEN 'application_process' END, CASE WHEN contains(t, 'fee') THEN 'fees_funding_rule' END, CASE WHEN contains(t, 'language') THEN 'language_proof_rule' END, CASE WHEN contains(t, 'programme') THEN 'degree_program' END], lambda x: x IS NOT NULL), ',') AS types FROM u""")  # fmt: skip
def infer_types(spark: SparkSession, d: str) -> DataFrame:
    """Types that a title suggests, several if need be."""
    t = F.coalesce(F.lower("title"), F.lit(""))
    has = lambda label, *w: F.when(L._any(t, *w), F.lit(label))
    return table(spark, d, "web_documents").select("id", F.array_join(F.array_compact(F.array(has("application_process", "application", "enrol"), has("fees_funding_rule", "fee"), has("language_proof_rule", "language"), has("degree_program", "programme"))), ",").alias("types"))


@query("eval_match", """
    WITH t AS (SELECT id, tags FROM qa_pairs) SELECT id, coalesce(list_has_any(tags, ['fees', 'housing']), false) AS match FROM t""")  # fmt: skip
def eval_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether any expected label was found."""
    return table(spark, d, "qa_pairs").select("id", F.coalesce(F.arrays_overlap("tags", F.array(F.lit("fees"), F.lit("housing"))), F.lit(False)).alias("match"))


@query("explicit_degree", """
    SELECT request_id, CASE WHEN contains(lower(email_text), 'master') THEN 'master' WHEN contains(lower(email_text), 'bachelor') OR contains(lower(email_text), 'b.sc.') THEN 'bachelor' ELSE 'none' END AS degree FROM email_requests""")  # fmt: skip
def explicit_degree(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("email_text")
    return table(spark, d, "email_requests").select("request_id", F.when(F.contains(low, F.lit("master")), "master").when(L._any(low, "bachelor", "b.sc."), "bachelor").otherwise("none").alias("degree"))


_COMPLAINT, _FOLLOW = "no answer|still waiting|keine antwort|once more|erneut", "quick reply|vielen dank für die antwort|again|noch einmal"


@query("classify_followup", f"""
    WITH t AS (SELECT request_id, lower(email_text) AS x, count(*) OVER (PARTITION BY coalesce(thread_id, 'unknown_thread') ORDER BY received_at, request_id) AS turn FROM email_requests)
    SELECT request_id, CASE WHEN regexp_matches(x, '{_COMPLAINT}') THEN 'complaint' WHEN turn > 1 AND regexp_matches(x, '{_FOLLOW}') THEN 'follow_up' ELSE 'new' END AS kind FROM t""")  # fmt: skip
def classify_followup(spark: SparkSession, d: str) -> DataFrame:
    """Complaints, follow-ups (only in a thread that is known) and new questions."""
    from ..operators.upsert import running_count

    m = table(spark, d, "email_requests").select("request_id", "received_at", F.coalesce("thread_id", F.lit("unknown_thread")).alias("thread"), F.regexp_like(F.lower("email_text"), F.lit(_COMPLAINT)).alias("c"), F.regexp_like(F.lower("email_text"), F.lit(_FOLLOW)).alias("f"))
    t = running_count(m, "thread", "received_at", "request_id", "turn")
    return t.select("request_id", F.when(F.col("c"), "complaint").when((F.col("turn") > 1) & F.col("f"), "follow_up").otherwise("new").alias("kind"))


_KEYWORDS, _PATHS, _CRITICAL = ("semester", "module", "exam", "thesis", "scholarship", "visa"), ("/en/", "/de/"), ("handbook", "contact", "help")


@query("relevance_score", "SELECT id, (" + " + ".join(f"2 * ((length(lower(title)) - length(replace(lower(title), '{k}', ''))) // {len(k)})" for k in _KEYWORDS) + f" + CASE WHEN {_has('lower(url)', *_PATHS)} THEN 10 ELSE 0 END + CASE WHEN {_has('lower(url)', *_CRITICAL)} THEN 15 ELSE 0 END)::INTEGER AS score FROM web_documents WHERE title IS NOT NULL AND url IS NOT NULL")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "web_documents").where("title IS NOT NULL AND url IS NOT NULL")
    return w.select("id", L.relevance(F.col("title"), F.col("url"), _KEYWORDS, _PATHS, _CRITICAL).alias("score"))


@query("relevance_filter", "SELECT id FROM web_documents WHERE title IS NOT NULL AND url IS NOT NULL AND (" + " + ".join(f"2 * ((length(lower(title)) - length(replace(lower(title), '{k}', ''))) // {len(k)})" for k in _KEYWORDS) + f" + CASE WHEN {_has('lower(url)', *_PATHS)} THEN 10 ELSE 0 END + CASE WHEN {_has('lower(url)', *_CRITICAL)} THEN 15 ELSE 0 END) > 10")
def relevance_filter(spark: SparkSession, d: str) -> DataFrame:
    return relevance_score(spark, d).where("score > 10").select("id")


_CAT = [("application", "admissions"), ("exam", "academic_affairs"), ("housing", "campus_life"), ("international", "international"), ("library", "facilities"), ("careers", "career_services")]


@query("categorize_content", "SELECT id, CASE " + " ".join(f"WHEN contains(lower(coalesce(title, '')), '{w}') THEN '{c}'" for w, c in _CAT) + " ELSE 'student_services' END AS category FROM site_objects")
def categorize_content(spark: SparkSession, d: str) -> DataFrame:
    """The first category whose word stands in the title."""
    t = F.lower(F.coalesce("title", F.lit("")))
    return table(spark, d, "site_objects").select("id", L.first_label([(F.contains(t, F.lit(w)), c) for w, c in _CAT], "student_services").alias("category"))


# --- names in texts ----------------------------------------------------------------------------------------------
_NAMES = """
    n AS (SELECT min(id) AS ord, title AS name, trim(regexp_replace(lower(replace(title, '&', ' and ')), '[^a-z0-9äöüß]+', ' ', 'g')) AS a FROM site_objects WHERE object_type = 'degree_program' AND title IS NOT NULL GROUP BY title)"""


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "site_objects").where("object_type = 'degree_program' AND title IS NOT NULL")
    return o.groupBy(F.col("title").alias("name")).agg(F.min("id").alias("ord")).withColumn("alias", F.col("name"))


@query("programme_exact_match", f"""
    WITH {_NAMES}, t AS (SELECT request_id, ' ' || trim(regexp_replace(lower(replace(email_text, '&', ' and ')), '[^a-z0-9äöüß]+', ' ', 'g')) || ' ' AS t FROM email_requests),
    h AS (SELECT t.request_id, n.name, CASE WHEN length(n.a) > 4 THEN 1.0 ELSE 0.92 END::DOUBLE AS score, n.ord FROM t JOIN n ON contains(t.t, ' ' || n.a || ' ') WHERE n.a <> '')
    SELECT request_id, name, score FROM h QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) = 1""")  # fmt: skip
def programme_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return L.exact_matches(table(spark, d, "email_requests"), _catalogue(spark, d), "request_id", "email_text")


@query("programme_longest_match", f"""
    WITH {_NAMES.replace("replace(title, '&', ' and ')", 'title')}, t AS (SELECT request_id, ' ' || {match_sql('email_text')} || ' ' AS t FROM email_requests),
    h AS (SELECT t.request_id, n.name, length(n.a) + CASE WHEN upper(n.name) = n.name AND regexp_matches(n.name, '[A-Z]') THEN 100 ELSE 0 END AS score, n.ord FROM t JOIN n ON contains(t.t, ' ' || n.a || ' ') WHERE length(n.a) >= 4)
    SELECT request_id, name, score::INTEGER AS score FROM h QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, ord) = 1""")  # fmt: skip
def programme_longest_match(spark: SparkSession, d: str) -> DataFrame:
    return L.longest_matches(table(spark, d, "email_requests"), _catalogue(spark, d), "request_id", "email_text")


@query("programme_fuzzy_match")
def programme_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The programme most like a run of words of each mail, its subject and its whole text."""
    return L.fuzzy_matches(table(spark, d, "email_requests"), _catalogue(spark, d), "request_id", F.concat_ws("\n", "subject", "email_text"))


@query("programme_page_match", """
    WITH p AS (SELECT DISTINCT lower(title) AS t FROM site_objects WHERE object_type = 'degree_program' AND title IS NOT NULL)
    SELECT DISTINCT s.id, p.t AS programme FROM site_objects s JOIN p ON p.t = lower(s.title) OR p.t = regexp_extract(lower(s.title), '(?: for | in | at )(.*)$', 1)""")  # fmt: skip
def programme_page_match(spark: SparkSession, d: str) -> DataFrame:
    """Pages about a programme: of its name, or with it behind for, in or at. The OR is a union of two equi-joins."""
    o = table(spark, d, "site_objects").where("title IS NOT NULL")
    p = o.where("object_type = 'degree_program'").select(F.lower("title").alias("programme")).distinct()
    one = o.select("id", F.lower("title").alias("programme"))
    two = o.select("id", F.regexp_extract(F.lower("title"), "(?: for | in | at )(.*)$", 1).alias("programme"))
    return one.unionAll(two).join(p, "programme").select("id", "programme").distinct()


@query("programme_page_evidence")
def programme_page_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each programme by equality, containment either way, or host; these pages have no aliases."""
    o = table(spark, d, "site_objects")
    p = o.where("object_type = 'degree_program' AND title IS NOT NULL").select(F.lower("title").alias("programme"), "url")
    return L.page_matches(o.select("id", "title", "url", F.array().cast("array<string>").alias("aliases")), p)


_TERMS = {"exams": ("exam", "thesis"), "fees": ("fee", "eur "), "visa": ("visa", "residence")}


#: More points of a topic: part of the page looked at, what it must have there, points.
_BONUS = {"fees": (("url", "finan", 15), ("text", "eur [0-9]", 20)), "exams": (("text", "registration", 8),), "visa": (("url", "international", 10), ("text", "language", 8))}
_PARTS = "(SELECT id, lower(coalesce(title, '')) AS title, lower(coalesce(url, '')) AS url, lower(coalesce(raw_json, '')) AS text FROM site_objects)"


def _points_sql(topic: str) -> str:
    plain = [f"CASE WHEN contains({part}, '{t}') THEN {n} ELSE 0 END" for t in _TERMS[topic] for part, n in (("title", 5), ("url", 5), ("text", 2))]
    return " + ".join([*plain, *(f"CASE WHEN regexp_matches({part}, '{p}') THEN {n} ELSE 0 END" for part, p, n in _BONUS[topic])])


@query("page_topic_score", "SELECT topic, id, score FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS topic, id, ({_points_sql(k)})::INTEGER AS score FROM {_PARTS}" for k in _TERMS) + ") WHERE score > 0")
def page_topic_score(spark: SparkSession, d: str) -> DataFrame:
    """Points of a page for each topic: terms in title (5), URL (5) and text (2), and what a table of bonuses adds."""
    low = {c: F.lower(F.coalesce(c if c != "text" else "raw_json", F.lit(""))) for c in ("title", "url", "text")}
    score = lambda k: L.topic_points(low, _TERMS[k], _BONUS[k])
    s = table(spark, d, "site_objects").select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("topic"), score(k).alias("score")) for k in _TERMS))).alias("x"))
    return s.select("x.topic", "id", "x.score").where("score > 0")


@query("official_docs", "WITH s AS (" + " UNION ALL ".join(f"SELECT '{k}' AS topic, id, ({_points_sql(k)})::INTEGER AS score FROM {_PARTS}" for k in _TERMS) + ") SELECT topic, id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, id) <= 3")
def official_docs(spark: SparkSession, d: str) -> DataFrame:
    """The three best pages of each topic."""
    w = Window.partitionBy("topic").orderBy(F.desc("score"), "id")
    return page_topic_score(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("first_citation", """
    WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
    SELECT source, min(n) FILTER (WHERE regexp_matches(lower(text), 'fee of eur|kostet das angebot')) AS first_doc FROM r GROUP BY 1""")  # fmt: skip
def first_citation(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's numbered documents the first that speaks of a fee."""
    from ..operators.upsert import numbered

    r = numbered(table(spark, d, "documents").select("source", "doc_id", F.regexp_like(F.lower("text"), F.lit("fee of eur|kostet das angebot")).alias("hit")), "source", "doc_id", "n")
    return r.groupBy("source").agg(F.min(F.when(F.col("hit"), F.col("n"))).cast("long").alias("first_doc"))


# --- drafts ------------------------------------------------------------------------------------------------------
_DRAFT = """'Answer on ' || coalesce(tags[1], 'nothing') || CASE WHEN coalesce(len(tags), 0) > 0 THEN ' [Doc 1]' ELSE '' END || CASE WHEN coalesce(len(tags), 0) > 1 THEN ' [Doc 7]' ELSE '' END"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce(F.size("tags"), F.lit(0))
    draft = F.concat(F.lit("Answer on "), F.coalesce(F.get("tags", F.lit(0)), F.lit("nothing")), F.when(n > 0, " [Doc 1]").otherwise(""), F.when(n > 1, " [Doc 7]").otherwise(""))
    return table(spark, d, "qa_pairs").select("id", draft.alias("draft"), n.alias("n"))


@query("validate_draft", f"""
    WITH f AS (SELECT id, {_DRAFT} AS draft, coalesce(len(tags), 0) AS n FROM qa_pairs), c AS (SELECT *, list_distinct(list_transform(regexp_extract_all(draft, '\\[Doc ([0-9]+)\\]', 1), lambda x: x::INTEGER)) AS k FROM f),
    v AS (SELECT *, len(k) > 0 AND len(list_filter(k, lambda x: x < 1 OR x > n)) = 0 AS valid FROM c)
    SELECT id, len(k)::INTEGER AS citation_count, valid AS citations_valid, n > 0 AND valid AS is_grounded,
      round(CASE WHEN n > 0 THEN 0.35 ELSE 0 END + CASE WHEN n > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(k) > 0 THEN 0.25 ELSE 0 END + CASE WHEN valid THEN 0.2 ELSE 0 END, 2)::DOUBLE AS confidence,
      array_to_string(list_filter([CASE WHEN n = 0 THEN 'No topics detected' END, CASE WHEN n = 0 THEN 'No evidence documents retrieved' END, CASE WHEN len(k) = 0 THEN 'No citations in draft' END, CASE WHEN len(k) > 0 AND NOT valid THEN 'Draft contains invalid citation numbers' END], lambda x: x IS NOT NULL), '; ') AS review_reason FROM v""")  # fmt: skip
def validate_draft(spark: SparkSession, d: str) -> DataFrame:
    """Checks of drafts: citations, grounding, confidence, reasons for review."""
    return _drafts(spark, d).select("id", L.check_draft(F.col("draft"), F.col("n"), F.col("n"), ("admission is guaranteed",)).alias("c")).select("id", "c.*")


@query("extractive_draft", """
    SELECT id, E'Thank you for your enquiry.\\n' || coalesce(array_to_string(list_transform(range(1, least(len(tags), 4) + 1), lambda i: 'Regarding ' || tags[i] || ', see [Doc ' || least(i, 3) || '].'), E'\\n'), '') AS draft FROM qa_pairs""")  # fmt: skip
def extractive_draft(spark: SparkSession, d: str) -> DataFrame:
    """A draft from templates: a line for each of at most four topics with the document to see."""
    line = lambda t, i: F.concat(F.lit("Regarding "), t, F.lit(", see [Doc "), F.least(i + 1, F.lit(3)).cast("string"), F.lit("]."))
    return table(spark, d, "qa_pairs").select("id", F.concat(F.lit("Thank you for your enquiry.\n"), F.coalesce(F.array_join(F.transform(F.slice("tags", 1, 4), line), "\n"), F.lit(""))).alias("draft"))


@query("rewrite_refs", """
    WITH w AS (SELECT id, coalesce(title, 'This') AS t, coalesce(links, []) AS l, length(coalesce(title, '')) % 4 + 1 AS n FROM web_documents)
    SELECT id, t || ' ' || CASE WHEN len(l) >= n THEN '(' || l[n].url || ')' ELSE '(source web - ' || n || ')' END || ', first ' || CASE WHEN len(l) >= 1 THEN '(' || l[1].url || ')' ELSE '(Source web - 1)' END || '; see (source web - 99)' AS v FROM w""")  # fmt: skip
def rewrite_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of a line made of each title as its document's links; unknown numbers stay."""
    urls = F.transform(F.coalesce("links", F.array().cast("array<struct<url:string,text:string>>")), lambda x: x["url"])
    n = (F.char_length(F.coalesce("title", F.lit(""))) % 4 + 1).cast("string")
    draft = F.concat(F.coalesce("title", F.lit("This")), F.lit(" (source web - "), n, F.lit("), first (Source web - 1); see (source web - 99)"))
    return table(spark, d, "web_documents").select("id", L.rewrite_references(draft, urls).alias("v"))


_MANY = "regexp_replace({0}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


@query("parse_subqueries", f"""
    WITH g AS (SELECT id, list_filter([{_MANY.format("question")}, '', {_MANY.format("answer")}], lambda x: x <> '') AS g FROM qa_pairs) SELECT id, CASE WHEN len(g) > 1 THEN array_to_string(g, ' | ') END AS v FROM g""")  # fmt: skip
def parse_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """Lists of sub-questions from a model's answers: thoughts and code fences off, JSON read, at most four, null for fewer than two."""
    raw = F.concat(F.lit("<think>x</think>```json\n"), F.to_json(F.array("question", F.lit(" "), "answer")), F.lit("\n```"))
    body = F.regexp_replace(F.regexp_replace(T.strip_think(raw), r"^```[^\n]*\n", ""), r"\n?```\s*$", "")
    got = F.filter(F.transform(F.slice(F.from_json(body, "array<string>"), 1, 4), T.trim_ws), lambda x: x != "")
    return table(spark, d, "qa_pairs").select("id", F.when(F.size(got) > 1, F.array_join(got, " | ")).alias("v"))


@query("training_examples", """
    SELECT id AS key, 'qa' AS kind, question AS prompt, answer AS completion FROM qa_pairs WHERE question IS NOT NULL AND answer IS NOT NULL
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'summary', 'Tell me about ' || title, left(text, 1000) FROM documents WHERE title IS NOT NULL AND text IS NOT NULL""")  # fmt: skip
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and completion rows from questions and from documents."""
    qa = table(spark, d, "qa_pairs").where("question IS NOT NULL AND answer IS NOT NULL").select(F.col("id").alias("key"), F.lit("qa").alias("kind"), F.col("question").alias("prompt"), F.col("answer").alias("completion"))
    docs = table(spark, d, "documents").where("title IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("string"), F.lit("summary"), F.concat(F.lit("Tell me about "), "title"), F.substring("text", 1, 1000))
    return qa.unionAll(docs)


@query("url_object_id", """
    WITH p AS (SELECT id, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x NOT IN ('', 'en', 'de')) AS p FROM site_objects)
    SELECT id, CASE WHEN coalesce(len(p), 0) = 0 THEN 'unknown' WHEN len(p) >= 2 THEN p[-2] || '-' || p[-1] ELSE p[-1] END AS v FROM p""")  # fmt: skip
def url_object_id(spark: SparkSession, d: str) -> DataFrame:
    """The last two parts of a URL's path, without the language."""
    parts = F.filter(F.split(T.url_path(F.coalesce("url", F.lit(""))), "/"), lambda x: ~x.isin("", "en", "de"))
    v = F.when(F.size(parts) == 0, "unknown").when(F.size(parts) >= 2, F.concat(F.element_at(parts, -2), F.lit("-"), F.element_at(parts, -1))).otherwise(F.element_at(parts, -1))
    return table(spark, d, "site_objects").select("id", v.alias("v"))

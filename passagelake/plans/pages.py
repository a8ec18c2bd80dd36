"""Structure of web pages and what they tell their readers, over markup built from every stored page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.html import extract_guidance, extract_pages
from ..session import table
from .registry import query

BASE, KEYWORDS = "https://www.example.org", ("language", "degree", "overview")


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def page_markup(spark: SparkSession, d: str) -> DataFrame:
    """snapshot_id, html: title, bulleted lines as a list of requirements, dashed ones as a procedure, lines with bars as a table, sections, the same as questions, related pages as links."""
    p = table(spark, d, "overview_pages").where("content.full_text IS NOT NULL")
    lines = F.split("content.full_text", "\n")
    marked = lambda m: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(m))), lambda x: F.substring(x, 3, 1 << 30))
    each = lambda a, before, after: F.array_join(F.transform(a, lambda x: F.concat(F.lit(before), _escaped(x), F.lit(after))), "")
    some = lambda a, html: F.when(F.size(a) > 0, html).otherwise("")
    wanted, steps, rows = marked("• "), marked("- "), F.filter(lines, lambda x: F.contains(x, F.lit(" | ")))
    title = _escaped(F.col("metadata.title"))
    sections = F.coalesce("content.sections", F.array().cast("array<struct<heading:string,level:int,content:string>>"))
    tag = lambda s: F.concat(F.lit("h"), F.least(F.greatest(F.coalesce(s["level"], F.lit(2)), F.lit(1)), F.lit(6)).cast("string"), F.lit(">"))
    text = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("<"), tag(s), _escaped(s["heading"]), F.lit("</"), tag(s), F.lit("<p>"), _escaped(s["content"]), F.lit("</p>"))), "")
    asked = F.array_join(F.transform(sections, lambda s: F.concat(F.lit("<h4>"), _escaped(s["heading"]), F.lit("</h4><p>"), _escaped(s["content"]), F.lit("</p>"))), "")
    cells = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), each(F.split(r, r" \| "), "<td>", "</td>"), F.lit("</tr>"))), "")
    links = F.array_join(F.transform(F.coalesce("related_pages", F.array().cast("array<string>")), lambda r: F.concat(F.lit('<a href="/en/'), _escaped(r), F.lit('/">'), _escaped(r), F.lit("</a> "))), "")
    html = F.concat(
        F.lit("<html><head><title>"), title, F.lit("</title></head><body><header>Head</header><nav>Menu</nav><main><h1>"), title, F.lit("</h1>"),
        some(wanted, F.concat(F.lit("<h2>Entry requirements</h2><ul>"), each(wanted, "<li>", "</li>"), F.lit("</ul>"))),
        some(steps, F.concat(F.lit("<h3>How to go on</h3><ol>"), each(steps, "<li>", "</li>"), F.lit("</ol>"))),
        some(rows, F.concat(F.lit("<table>"), cells, F.lit("</table>"))),
        text, F.lit("<div>FAQ"), asked, F.lit("</div><p>"), links, F.lit("</p></main><footer>Foot</footer></body></html>"))
    return p.select("snapshot_id", html.alias("html"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return extract_pages(page_markup(spark, d), ["snapshot_id"], "html", BASE)


def _guidance(spark: SparkSession, d: str) -> DataFrame:
    return extract_guidance(page_markup(spark, d), ["snapshot_id"], "html", KEYWORDS, BASE)


_bare = lambda x: f"regexp_replace({x}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"
_PAGES = f"""
    p AS (SELECT snapshot_id, metadata.title AS title, string_split(content.full_text, E'\\n') AS lines, coalesce(content.sections, []) AS sections, coalesce(related_pages, []) AS related FROM overview_pages WHERE content.full_text IS NOT NULL),
    m AS (SELECT *, list_transform(list_filter(lines, lambda x: starts_with(x, '• ')), lambda x: {_bare('substr(x, 3)')}) AS wanted, list_transform(list_filter(lines, lambda x: starts_with(x, '- ')), lambda x: {_bare('substr(x, 3)')}) AS steps,
                 list_filter(lines, lambda x: contains(x, ' | ')) AS rows_ FROM p)"""


@query("html_lists", f"WITH {_PAGES} SELECT snapshot_id, 'ul' AS type, unnest(wanted) AS item FROM m UNION ALL SELECT snapshot_id, 'ol', unnest(steps) FROM m")
def html_lists(spark: SparkSession, d: str) -> DataFrame:
    """Items of all lists."""
    x = _parts(spark, d).select("snapshot_id", F.explode("page.lists").alias("l"))
    return x.select("snapshot_id", F.col("l.type").alias("type"), F.explode("l.items").alias("item"))


@query("html_tables", f"""
    WITH {_PAGES} SELECT snapshot_id, unnest(list_transform(rows_, lambda r: array_to_string(list_transform(string_split(r, ' | '), lambda c: {_bare('c')}), '|'))) AS cells FROM m""")  # fmt: skip
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of all tables."""
    x = _parts(spark, d).select("snapshot_id", F.explode("page.tables").alias("t"))
    return x.select("snapshot_id", F.explode(F.transform("t.rows", lambda r: F.array_join(r, "|"))).alias("cells"))


@query("html_headings", f"""
    WITH {_PAGES} SELECT snapshot_id, 1 AS level, {_bare("coalesce(title, '')")} AS text FROM m UNION ALL SELECT snapshot_id, 2, 'Entry requirements' FROM m WHERE len(wanted) > 0 UNION ALL SELECT snapshot_id, 3, 'How to go on' FROM m WHERE len(steps) > 0
    UNION ALL SELECT snapshot_id, least(greatest(coalesce(s.level, 2), 1), 6)::INTEGER, {_bare("coalesce(s.heading, '')")} FROM (SELECT snapshot_id, unnest(sections) AS s FROM m)
    UNION ALL SELECT snapshot_id, 4, {_bare("coalesce(s.heading, '')")} FROM (SELECT snapshot_id, unnest(sections) AS s FROM m)""")  # fmt: skip
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("snapshot_id", F.explode("page.headings").alias("h")).select("snapshot_id", "h.level", "h.text")


@query("html_links", f"WITH {_PAGES} SELECT snapshot_id, r AS text, '{BASE}/en/' || r || '/' AS url FROM (SELECT snapshot_id, unnest(related) AS r FROM m) WHERE r <> ''")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the main area, made absolute."""
    return _parts(spark, d).select("snapshot_id", F.explode("page.links").alias("l")).select("snapshot_id", "l.text", "l.url")


@query("html_extract", f"""
    WITH {_PAGES} SELECT snapshot_id, (1 + (len(wanted) > 0)::INT + (len(steps) > 0)::INT + 2 * len(sections))::INTEGER AS n_headings, ((len(wanted) > 0)::INT + (len(steps) > 0)::INT)::INTEGER AS n_lists, (len(rows_) > 0)::INTEGER AS n_tables,
      len(list_filter(related, lambda r: r <> ''))::INTEGER AS n_links FROM m""")  # fmt: skip
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    """All parts of every page in one pass: how many of each."""
    return _parts(spark, d).select("snapshot_id", *(F.size(f"page.{c}").alias(f"n_{c}") for c in ("headings", "lists", "tables", "links")))


@query("html_titles", "SELECT snapshot_id, regexp_replace(coalesce(metadata.title, ''), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS title FROM overview_pages WHERE content.full_text IS NOT NULL")
def html_titles(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("snapshot_id", "page.title")


@query("html_requirements", f"WITH {_PAGES} SELECT snapshot_id, unnest(wanted[1:10]) AS item FROM m")
def html_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Requirements: items of lists behind their headings, at most ten a list."""
    return _guidance(spark, d).select("snapshot_id", F.explode("page.requirements").alias("item"))


@query("html_procedures", f"WITH {_PAGES} SELECT snapshot_id, 'How to go on' AS title, array_to_string(steps[1:15], ' > ') AS steps FROM m WHERE len(steps) > 0")
def html_procedures(spark: SparkSession, d: str) -> DataFrame:
    """Procedures: ordered lists behind their headings, at most fifteen steps."""
    x = _guidance(spark, d).select("snapshot_id", F.explode("page.procedures").alias("p"))
    return x.select("snapshot_id", "p.title", F.array_join("p.steps", " > ").alias("steps"))


@query("html_faqs", f"""
    WITH {_PAGES} SELECT snapshot_id, {_bare("coalesce(s.heading, '')")} AS question, left({_bare("coalesce(s.content, '')")}, 500) AS answer FROM (SELECT snapshot_id, unnest(sections[1:10]) AS s FROM m)""")  # fmt: skip
def html_faqs(spark: SparkSession, d: str) -> DataFrame:
    """Questions with what stands behind them, at most ten a block."""
    return _guidance(spark, d).select("snapshot_id", F.explode("page.faqs").alias("q")).select("snapshot_id", "q.question", "q.answer")


@query("html_useful_links", f"""
    WITH {_PAGES}, u AS (SELECT snapshot_id, list_filter(related, lambda r: {" OR ".join(f"contains(lower(r), '{k}')" for k in KEYWORDS)})[1:20] AS r FROM m)
    SELECT snapshot_id, '{BASE}/en/' || x || '/' AS url, left(x, 100) AS text FROM (SELECT snapshot_id, unnest(r) AS x FROM u)""")  # fmt: skip
def html_useful_links(spark: SparkSession, d: str) -> DataFrame:
    """Links whose text has a keyword, at most twenty a page."""
    return _guidance(spark, d).select("snapshot_id", F.explode("page.useful_links").alias("l")).select("snapshot_id", "l.url", "l.text")


@query("html_body_text", f"""
    WITH {_PAGES}, t AS (SELECT snapshot_id, concat_ws(' ', title, CASE WHEN len(wanted) > 0 THEN 'Entry requirements ' || array_to_string(wanted, ' ') END, CASE WHEN len(steps) > 0 THEN 'How to go on ' || array_to_string(steps, ' ') END,
      array_to_string(list_transform(rows_, lambda r: replace(r, ' | ', ' ')), ' '), array_to_string(list_transform(sections, lambda s: concat_ws(' ', s.heading, s.content)), ' '), 'FAQ', array_to_string(list_transform(sections, lambda s: concat_ws(' ', s.heading, s.content)), ' '), array_to_string(related, ' ')) AS t FROM m)
    SELECT snapshot_id, md5({_bare("regexp_replace(t, '[\\s\\x{A0}]+', ' ', 'g')")}) AS text_md5 FROM t""")  # fmt: skip
def html_body_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of the main area by the plain rule: no navigation, head and foot."""
    return _guidance(spark, d).select("snapshot_id", F.md5("page.body_text").alias("text_md5"))


@query("training_rows", f"""
    WITH {_PAGES} SELECT snapshot_id, 'faq' AS kind, {_bare("coalesce(s.heading, '')")} AS prompt, left({_bare("coalesce(s.content, '')")}, 500) AS completion FROM (SELECT snapshot_id, unnest(sections[1:10]) AS s FROM m)
    UNION ALL SELECT snapshot_id, 'procedure', 'How do I how to go on?', E'Here are the steps:\\n' || array_to_string(list_transform(steps[1:15], lambda x, i: i || '. ' || x), E'\\n') FROM m WHERE len(steps) > 0""")  # fmt: skip
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prompts and completions from the questions and procedures of pages. The wording around a procedure."""
    g = _guidance(spark, d)
    asked = g.select("snapshot_id", F.explode("page.faqs").alias("q")).select("snapshot_id", F.lit("faq").alias("kind"), F.col("q.question").alias("prompt"), F.col("q.answer").alias("completion"))
    p = g.select("snapshot_id", F.explode("page.procedures").alias("p"))
    steps = F.array_join(F.transform("p.steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return asked.unionAll(p.select("snapshot_id", F.lit("procedure"), F.concat(F.lit("How do I "), F.lower("p.title"), F.lit("?")), F.concat(F.lit("Here are the steps:\n"), steps)))

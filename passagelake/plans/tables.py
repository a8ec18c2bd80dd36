"""Filters, joins and aggregates over the content tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import table
from .registry import query

WS = r"[ \t\r\n\f\x0B]"  # of both engines' regular expressions
_TRIM = lambda c: f"regexp_replace({c}, '^[ \\t\\r\\n\\f\\v]+|[ \\t\\r\\n\\f\\v]+$', '', 'g')"


def _t(name: str):
    return lambda spark, d: table(spark, d, name)


_docs, _chunks, _web, _qa, _objects, _webdocs, _mails = map(_t, ("documents", "chunks", "web_chunks", "qa_pairs", "site_objects", "web_documents", "email_requests"))


# --- filters -----------------------------------------------------------------------------------------------------
@query("docs_by_type", "SELECT doc_id, source, title FROM documents WHERE object_type = 'degree_program'")
def docs_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Equality filter that reaches the scan."""
    return _docs(spark, d).where(F.col("object_type") == "degree_program").select("doc_id", "source", "title")


@query("docs_of_types", "SELECT object_type, count(*) AS n FROM site_objects WHERE object_type IN ('faq_support', 'fees_funding_rule', 'application_process') GROUP BY 1")
def docs_of_types(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).where(F.col("object_type").isin("faq_support", "fees_funding_rule", "application_process")).groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


@query("point_lookup", "SELECT id, object_id, title FROM site_objects WHERE object_id = (SELECT min(object_id) FROM site_objects)")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """All versions of one object, by its id."""
    o = _objects(spark, d)
    return o.join(F.broadcast(o.agg(F.min("object_id").alias("object_id"))), "object_id").select("id", "object_id", "title")  # one row


@query("keyword_search", """
    SELECT doc_id, title FROM documents WHERE contains(lower(concat_ws(' ', title, object_type, text)), 'semester ticket') ORDER BY doc_id LIMIT 10""")  # fmt: skip
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents with a phrase in title, type or text."""
    hay = F.lower(F.concat_ws(" ", "title", "object_type", "text"))
    return _docs(spark, d).where(F.contains(hay, F.lit("semester ticket"))).select("doc_id", "title").orderBy("doc_id").limit(10)


@query("skip_short", f"SELECT doc_id FROM documents WHERE length({_TRIM('text')}) >= 300")
def skip_short(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.char_length(T.normalize_text("text")) >= 300).select("doc_id")


@query("chunk_validity", f"""
    SELECT id, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= length(text) * 0.4
               AND len(regexp_split_to_array({_TRIM('text')}, '[ \\t\\r\\n\\f\\v]+')) >= 15 AND length(text) > 0 AS valid
    FROM web_chunks""")  # fmt: skip
def chunk_validity(spark: SparkSession, d: str) -> DataFrame:
    return _web(spark, d).select("id", T.chunk_valid("text").alias("valid"))


@query("thin_documents", f"""
    WITH p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, '.'), lambda x: {_TRIM('x')}), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, length(text) < 400 OR length(coalesce(text, '')) < 600 OR length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(text), 1) < 0.5
           OR (len(s) > 5 AND len(list_filter(s, lambda x: length(x) < 80)) / greatest(len(s), 1) > 0.7) AS thin FROM p""")  # fmt: skip
def thin_documents(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.is_thin(F.col("text"), F.col("text")).alias("thin"))


@query("url_filter", """
    SELECT id, url FROM site_objects WHERE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' AND contains(url, '/en/')
      AND NOT regexp_matches(lower(url), '\\.(pdf|jpg|png|zip|docx?)$')""")  # fmt: skip
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    """URLs with a host, of the English part, that lead to no file."""
    u = F.col("url")
    return _objects(spark, d).where((T.url_host(u) != "") & F.contains(u, F.lit("/en/")) & ~F.regexp_like(F.lower(u), F.lit(r"\.(pdf|jpg|png|zip|docx?)$"))).select("id", "url")


@query("english_pages", """
    SELECT id FROM web_documents WHERE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> ''
      AND starts_with(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/en/')""")  # fmt: skip
def english_pages(spark: SparkSession, d: str) -> DataFrame:
    return _webdocs(spark, d).where((T.url_host("url") != "") & F.startswith(T.url_path("url"), F.lit("/en/"))).select("id")


@query("ui_sources", "SELECT id, title, url FROM web_documents WHERE source_type = 'web' AND url IS NOT NULL AND url <> ''")
def ui_sources(spark: SparkSession, d: str) -> DataFrame:
    return _webdocs(spark, d).where("source_type = 'web' AND url IS NOT NULL AND url <> ''").select("id", "title", "url")


@query("confidence_clamp", "SELECT event_id, CAST(least(100, greatest(0, trunc((value / 50) * 100))) AS INTEGER) AS confidence_pct FROM events")
def confidence_clamp(spark: SparkSession, d: str) -> DataFrame:
    """A score as a whole percentage from 0 to 100, cut towards zero."""
    pct = F.least(F.lit(100), F.greatest(F.lit(0), (F.col("value") / 50 * 100).cast("int")))
    return table(spark, d, "events").select("event_id", pct.alias("confidence_pct"))


@query("email_validation", f"""
    SELECT request_id, CASE WHEN email_text IS NULL OR {_TRIM('email_text')} = '' THEN 'empty' WHEN length(email_text) > 2000 THEN 'too_long'
           WHEN top_k IS NULL OR top_k NOT BETWEEN 3 AND 10 THEN 'top_k' ELSE 'valid' END AS verdict FROM email_requests""")  # fmt: skip
def email_validation(spark: SparkSession, d: str) -> DataFrame:
    m = _mails(spark, d)
    v = F.when(F.coalesce(T.trim_ws("email_text"), F.lit("")) == "", "empty").when(F.char_length("email_text") > 2000, "too_long").when(F.coalesce(F.col("top_k").between(3, 10), F.lit(False)), "valid").otherwise("top_k")
    return m.select("request_id", v.alias("verdict"))


@query("paragraph_filter", """
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\n[ \\t\\r\\n\\f\\v]*\\n'),
             lambda p: NOT (contains(lower(p), 'eur ') OR contains(lower(p), 'euro'))), E'\\n\\n') AS kept FROM documents""")  # fmt: skip
def paragraph_filter(spark: SparkSession, d: str, terms: tuple[str, ...] = ("eur ", "euro")) -> DataFrame:
    """Texts without the paragraphs that contain one of the terms."""
    bad = lambda p: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(p), t))
    return _docs(spark, d).select("doc_id", F.array_join(F.filter(F.split("text", rf"\n{WS}*\n"), lambda p: ~bad(p)), "\n\n").alias("kept"))


# --- joins -------------------------------------------------------------------------------------------------------
@query("chunk_doc_join", """
    SELECT wc.id, d.title, d.url, wc.chunk_index, coalesce(len(coalesce(wc.contacts, d.contacts)), -1) AS n_contacts, coalesce(len(coalesce(wc.links, d.links)), -1) AS n_links
    FROM web_chunks wc JOIN web_documents d ON d.id = wc.document_id""")  # fmt: skip
def chunk_doc_join(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their documents' data; contacts and links fall back to the document's."""
    c = _web(spark, d).select("id", "document_id", "chunk_index", "contacts", "links").alias("c")
    w = _webdocs(spark, d).select(F.col("id").alias("document_id"), "title", "url", F.col("contacts").alias("dc"), F.col("links").alias("dl"))
    n = lambda a, b: F.coalesce(F.size(F.coalesce(a, b)).cast("long"), F.lit(-1))
    return c.join(w, "document_id").select("id", "title", "url", "chunk_index", n("contacts", "dc").alias("n_contacts"), n("links", "dl").alias("n_links"))


_LINKS = """
    urls AS (SELECT regexp_replace(url, '/+$', '') AS u, arg_max(id, id) AS target FROM web_documents WHERE url IS NOT NULL GROUP BY 1),
    links AS (SELECT id, unnest(links).url AS url, unnest(range(len(links))) AS pos FROM web_documents WHERE links IS NOT NULL)"""


@query("link_resolution", f"""
    WITH {_LINKS}, hit AS (SELECT l.id, u.target, min(l.pos) AS pos FROM links l JOIN urls u ON regexp_replace(l.url, '/+$', '') = u.u GROUP BY 1, 2)
    SELECT id, target, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INTEGER) AS rank FROM hit""")  # fmt: skip
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links to known pages in order of first mention; of pages with one URL the one with the greatest id."""
    w = _webdocs(spark, d)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    urls = w.where("url IS NOT NULL").groupBy(bare("url").alias("u")).agg(F.max("id").alias("target"))
    links = w.select("id", F.posexplode("links").alias("pos", "l")).select("id", "pos", bare("l.url").alias("u"))
    hit = links.join(urls, "u").groupBy("id", "target").agg(F.min("pos").alias("pos"))
    return hit.select("id", "target", F.row_number().over(Window.partitionBy("id").orderBy("pos")).alias("rank"))


_LATEST = "latest AS (SELECT object_id, arg_max(id, id) AS id FROM site_objects GROUP BY 1), obj AS (SELECT s.* FROM site_objects s JOIN latest l USING (id))"


def latest_objects(spark: SparkSession, d: str) -> DataFrame:
    """The last version of every object."""
    o = _objects(spark, d)
    return o.join(o.groupBy("object_id").agg(F.max("id").alias("id")).select("id"), "id")


@query("related_objects", f"""
    WITH {_LATEST}, e AS (SELECT id, object_id, unnest(related_pages) AS target, unnest(range(len(related_pages))) AS pos FROM obj WHERE related_pages IS NOT NULL)
    SELECT e.object_id, CAST(e.pos AS INTEGER) AS pos, o.object_id AS related_id, o.object_type AS related_type FROM e JOIN obj o ON o.object_id = e.target""")  # fmt: skip
def related_objects(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the link graph; links that lead nowhere are dropped."""
    o = latest_objects(spark, d)
    e = o.select("object_id", F.posexplode("related_pages").alias("pos", "target"))
    return e.join(o.select(F.col("object_id").alias("related_id"), F.col("object_type").alias("related_type")), F.col("target") == F.col("related_id")).select("object_id", "pos", "related_id", "related_type")


@query("new_chunks_only", """
    SELECT id FROM web_chunks WHERE created_at >= TIMESTAMP '2025-01-01 00:00:00' AND content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM web_chunks WHERE created_at < TIMESTAMP '2025-01-01 00:00:00' AND content_hash IS NOT NULL)""")  # fmt: skip
def new_chunks_only(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a later load whose text an earlier load has not stored."""
    c = _web(spark, d).where("content_hash IS NOT NULL").select("id", "content_hash", "created_at")
    later = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return c.where(F.col("created_at") >= later).join(c.where(F.col("created_at") < later).select("content_hash"), "content_hash", "left_anti").select("id")


@query("doc_coverage", """
    SELECT d.id, d.source_type, count(c.id) AS n_chunks FROM web_documents d LEFT JOIN web_chunks c ON c.document_id = d.id GROUP BY 1, 2""")  # fmt: skip
def doc_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document, none included; counted before the join."""
    n = _web(spark, d).groupBy("document_id").agg(F.count("id").alias("n"))
    w = _webdocs(spark, d).select("id", "source_type")
    return w.join(n, w["id"] == n["document_id"], "left").select("id", "source_type", F.coalesce("n", F.lit(0)).alias("n_chunks"))


@query("dangling_links", f"""
    WITH {_LATEST}, e AS (SELECT object_id, unnest(related_pages) AS target FROM obj)
    SELECT e.object_id, count(*) AS n_dangling FROM e WHERE e.target NOT IN (SELECT object_id FROM obj) GROUP BY 1""")  # fmt: skip
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    o = latest_objects(spark, d)
    e = o.select("object_id", F.explode("related_pages").alias("target"))
    return e.join(o.select(F.col("object_id").alias("target")), "target", "left_anti").groupBy("object_id").agg(F.count(F.lit(1)).alias("n_dangling"))


# --- aggregates --------------------------------------------------------------------------------------------------
@query("retrieval_stats", """
    SELECT 'documents' AS name, count(*) AS n FROM web_documents UNION ALL SELECT 'web_chunks', count(*) FROM web_chunks UNION ALL SELECT 'qa_pairs', count(*) FROM qa_pairs""")  # fmt: skip
def retrieval_stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda n, t: t(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("documents", _webdocs).unionAll(one("web_chunks", _web)).unionAll(one("qa_pairs", _qa))


@query("readiness", """
    SELECT (SELECT count(*) FROM web_chunks) + (SELECT count(*) FROM qa_pairs) AS items, (SELECT count(*) FROM web_chunks) + (SELECT count(*) FROM qa_pairs) > 0 AS ready""")  # fmt: skip
def readiness(spark: SparkSession, d: str) -> DataFrame:
    return retrieval_stats(spark, d).where("name <> 'documents'").agg(F.sum("n").alias("items")).select("items", (F.col("items") > 0).alias("ready"))


@query("type_distribution", "SELECT coalesce(object_type, 'none') AS object_type, count(*) AS n FROM site_objects GROUP BY 1 ORDER BY n DESC, 1")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _objects(spark, d).groupBy(F.coalesce("object_type", F.lit("none")).alias("object_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "object_type")


@query("enrichment_stats", """
    SELECT count(*) AS n, count(*) FILTER (WHERE enriched) AS n_enriched, count(*) FILTER (WHERE still_thin) AS n_thin FROM chunks""")  # fmt: skip
def enrichment_stats(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if("enriched").alias("n_enriched"), F.count_if("still_thin").alias("n_thin"))


@query("chunks_per_doc", """
    SELECT round(avg(n), 2) AS avg_chunks, min(n) AS min_chunks, max(n) AS max_chunks FROM (SELECT document_id, count(*) AS n FROM web_chunks GROUP BY 1)""")  # fmt: skip
def chunks_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return _web(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 2).alias("avg_chunks"), F.min("n").alias("min_chunks"), F.max("n").alias("max_chunks"))


@query("chunk_count_histogram", "SELECT n AS chunk_count, count(*) AS num_documents FROM (SELECT document_id, count(*) AS n FROM web_chunks GROUP BY 1) GROUP BY 1")
def chunk_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _web(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")).groupBy("chunk_count").agg(F.count(F.lit(1)).alias("num_documents"))


@query("single_chunk_docs", "SELECT document_id FROM chunks GROUP BY 1 HAVING count(*) = 1")
def single_chunk_docs(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("document_id")


@query("length_stats", """
    SELECT min(length(text)) AS min_len, round(avg(length(text)), 6) AS avg_len, max(length(text)) AS max_len, count(*) AS n, sum(length(text))::BIGINT AS total FROM web_chunks""")  # fmt: skip
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.char_length("text").cast("long")
    return _web(spark, d).agg(F.min(n).alias("min_len"), F.round(F.avg(n), 6).alias("avg_len"), F.max(n).alias("max_len"), F.count(F.lit(1)).alias("n"), F.sum(n).alias("total"))


@query("length_histogram", "SELECT length(chunk_text) AS len, count(*) AS n FROM chunks GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy(F.char_length("chunk_text").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query("stale_lengths", "SELECT id FROM chunks WHERE chunk_text_len IS DISTINCT FROM length(chunk_text)")
def stale_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose stored length is no longer that of their text."""
    return _chunks(spark, d).where(~F.col("chunk_text_len").eqNullSafe(F.char_length("chunk_text"))).select("id")


@query("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM qa_pairs) GROUP BY 1 ORDER BY n DESC, tag")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


@query("tags_group", "SELECT coalesce(array_to_string(tags, '|'), 'none') AS tags, count(*) AS n FROM qa_pairs GROUP BY 1")
def tags_group(spark: SparkSession, d: str) -> DataFrame:
    return _qa(spark, d).groupBy(F.coalesce(F.array_join("tags", "|"), F.lit("none")).alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query("docs_most_chunks", """
    SELECT d.id, d.title, count(*) AS n FROM web_documents d JOIN web_chunks c ON c.document_id = d.id GROUP BY 1, 2 ORDER BY n DESC, d.id LIMIT 10""")  # fmt: skip
def docs_most_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A top-ten report; counted before the join."""
    n = _web(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return _webdocs(spark, d).select("id", "title").join(n, "id").select("id", "title", "n").orderBy(F.desc("n"), "id").limit(10)


@query("chunks_per_type", "SELECT o.object_type, count(*) AS n, count(*) FILTER (WHERE c.enriched) AS n_enriched FROM chunks c JOIN site_objects o ON o.id = c.document_id GROUP BY 1")
def chunks_per_type(spark: SparkSession, d: str) -> DataFrame:
    o = _objects(spark, d).select(F.col("id").alias("document_id"), "object_type")
    per = _chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("enriched").alias("e"))
    return per.join(o, "document_id").groupBy("object_type").agg(F.sum("n").alias("n"), F.sum("e").alias("n_enriched"))


@query("migration_report", """
    SELECT o.object_id, o.id, min(o.object_type) AS object_type, bool_or(coalesce(c.enriched, false)) AS enriched, bool_or(coalesce(c.still_thin, false)) AS still_thin, count(c.id) AS num_chunks,
           coalesce(sum(length(c.chunk_text)), 0)::BIGINT AS text_len FROM site_objects o LEFT JOIN chunks c ON c.document_id = o.id GROUP BY 1, 2""")  # fmt: skip
def migration_report(spark: SparkSession, d: str) -> DataFrame:
    """One row an object: its chunks, their text and flags."""
    per = _chunks(spark, d).groupBy(F.col("document_id").alias("id")).agg(F.bool_or("enriched").alias("e"), F.bool_or("still_thin").alias("t"), F.count("id").alias("num_chunks"), F.sum(F.char_length("chunk_text").cast("long")).alias("text_len"))
    z = lambda c, v: F.coalesce(c, F.lit(v))
    return _objects(spark, d).select("object_id", "id", "object_type").join(per, "id", "left").select("object_id", "id", "object_type", z("e", False).alias("enriched"), z("t", False).alias("still_thin"), z("num_chunks", 0).alias("num_chunks"), z("text_len", 0).alias("text_len"))


@query("migration_summary", """
    SELECT count(*) AS objects, count(*) FILTER (WHERE e) AS enriched, count(*) FILTER (WHERE t) AS still_thin, sum(n)::BIGINT AS chunks, round(avg(n), 6) AS mean_chunks
    FROM (SELECT document_id, bool_or(enriched) AS e, bool_or(still_thin) AS t, count(*) AS n FROM chunks GROUP BY 1)""")  # fmt: skip
def migration_summary(spark: SparkSession, d: str) -> DataFrame:
    per = _chunks(spark, d).groupBy("document_id").agg(F.bool_or("enriched").alias("e"), F.bool_or("still_thin").alias("t"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("objects"), F.count_if("e").alias("enriched"), F.count_if("t").alias("still_thin"), F.sum("n").alias("chunks"), F.round(F.avg("n"), 6).alias("mean_chunks"))


@query("classification_quality", """
    SELECT coalesce(classification_confidence, 'none') AS confidence, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct,
           count(*) FILTER (WHERE length(classification_notes) > 30 AND contains(lower(classification_notes), 'page')) AS specific_notes FROM site_objects GROUP BY 1""")  # fmt: skip
def classification_quality(spark: SparkSession, d: str) -> DataFrame:
    specific = (F.char_length("classification_notes") > 30) & F.contains(F.lower("classification_notes"), F.lit("page"))
    per = _objects(spark, d).groupBy(F.coalesce("classification_confidence", F.lit("none")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.count_if(specific).alias("specific_notes"))
    return per.select("confidence", "n", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("pct"), "specific_notes")  # a row a level


_FIELDS = ("url", "title", "page_id", "classification_confidence", "classification_notes", "raw_json")


@query("fill_rate", "SELECT field, count(*) FILTER (WHERE v IS NOT NULL AND trim(v) <> '') AS filled, count(*) AS total, round(count(*) FILTER (WHERE v IS NOT NULL AND trim(v) <> '') / count(*), 6) AS rate FROM ("
       + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS v FROM site_objects" for f in _FIELDS) + ") GROUP BY 1")
def fill_rate(spark: SparkSession, d: str) -> DataFrame:
    """Filled and empty values of every field, in one pass and one small aggregate."""
    o = _objects(spark, d)
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(c) != ""))
    one = o.agg(F.count(F.lit(1)).alias("total"), *(filled(f).alias(f) for f in _FIELDS))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled")) for f in _FIELDS))).alias("p")
    return one.select("total", pairs).select("p.field", "p.filled", "total", F.round(F.col("p.filled") / F.col("total"), 6).alias("rate"))


_JSON_FIELDS = {"degree_program": ("program_info.name", "program_info.degree_type", "program_info.language", "curriculum.description"), "curriculum_page": ("curriculum_info.module_type", "metadata.title", "metadata.url")}


@query("fill_rate_by_type", "SELECT object_type, field, count(*) FILTER (WHERE v IS NOT NULL AND trim(v) <> '') AS filled, count(*) AS total FROM ("
       + " UNION ALL ".join(f"SELECT object_type, '{f}' AS field, CASE WHEN json_valid(raw_json) THEN json_extract_string(raw_json, '$.{f}') END AS v FROM site_objects WHERE object_type = '{t}'" for t, fs in _JSON_FIELDS.items() for f in fs) + ") GROUP BY 1, 2")
def fill_rate_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Fill rates of nested fields by dotted path, a set of paths a type."""
    o = _objects(spark, d).where(F.col("object_type").isin(*_JSON_FIELDS)).select("object_type", "raw_json", F.expr("try_parse_json(raw_json)").alias("v"))
    of = lambda t: F.array(*(F.struct(F.lit(f).alias("field"), F.expr(f"try_variant_get(v, '$.{f}', 'string')").alias("value")) for f in _JSON_FIELDS[t]))
    e = o.select("object_type", F.explode(F.when(F.col("object_type") == "degree_program", of("degree_program")).otherwise(of("curriculum_page"))).alias("p"))
    return e.groupBy("object_type", "p.field").agg(F.count_if(F.col("p.value").isNotNull() & (F.trim("p.value") != "")).alias("filled"), F.count(F.lit(1)).alias("total"))


@query("fill_examples", """
    WITH s AS (SELECT id, object_type, (CASE WHEN url IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN classification_notes IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN last_scraped IS NOT NULL THEN 1 ELSE 0 END) / 4.0 AS score FROM site_objects),
    b AS (SELECT *, CASE WHEN score >= 0.7 THEN 'good' WHEN score < 0.4 THEN 'poor' END AS bucket FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_type, bucket ORDER BY id) AS rn FROM b WHERE bucket IS NOT NULL)
    SELECT object_type, bucket, id FROM r WHERE rn <= 3""")  # fmt: skip
def fill_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first three well and three poorly filled objects of each type."""
    score = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("url", "title", "classification_notes", "last_scraped")), F.lit(0)) / 4.0
    b = _objects(spark, d).select("object_type", "id", F.when(score >= 0.7, "good").when(score < 0.4, "poor").alias("bucket")).where("bucket IS NOT NULL")
    return b.withColumn("rn", F.row_number().over(Window.partitionBy("object_type", "bucket").orderBy("id"))).where("rn <= 3").select("object_type", "bucket", "id")


@query("gap_analysis", """
    SELECT coalesce(object_type, 'none') AS object_type, count(*) AS docs, count(*) FILTER (WHERE regexp_matches(text, '[0-9]{1,2}\\.[0-9]{1,2}\\.[0-9]{4}')) AS with_dates,
           count(*) FILTER (WHERE regexp_matches(text, 'EUR [0-9]')) AS with_amounts, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+')) AS with_mails FROM documents GROUP BY 1""")  # fmt: skip
def gap_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Texts by type that hold what a structured field could hold."""
    has = lambda p: F.count_if(F.regexp_like("text", F.lit(p)))
    return _docs(spark, d).groupBy(F.coalesce("object_type", F.lit("none")).alias("object_type")).agg(F.count(F.lit(1)).alias("docs"), has(r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}").alias("with_dates"), has("EUR [0-9]").alias("with_amounts"), has(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+").alias("with_mails"))


@query("opportunities", """
    WITH o AS (SELECT doc_id, object_type, unnest([CASE WHEN regexp_matches(text, 'EUR [0-9]') THEN 'amount' END, CASE WHEN regexp_matches(lower(text), 'deadline|before [0-9]') THEN 'deadline' END, CASE WHEN contains(lower(text), 'certificate') THEN 'document' END]) AS kind FROM documents WHERE object_type IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY object_type, kind ORDER BY doc_id) AS rn FROM o WHERE kind IS NOT NULL)
    SELECT object_type, kind, doc_id FROM r WHERE rn <= 3""")  # fmt: skip
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Per type and kind of signal the first three texts that could fill a field."""
    kinds = F.array_compact(F.array(F.when(F.regexp_like("text", F.lit("EUR [0-9]")), "amount"), F.when(F.regexp_like(F.lower("text"), F.lit("deadline|before [0-9]")), "deadline"), F.when(F.contains(F.lower("text"), F.lit("certificate")), "document")))
    o = _docs(spark, d).where("object_type IS NOT NULL").select("object_type", "doc_id", F.explode(kinds).alias("kind"))
    return o.withColumn("rn", F.row_number().over(Window.partitionBy("object_type", "kind").orderBy("doc_id"))).where("rn <= 3").select("object_type", "kind", "doc_id")


@query("category_summary", """
    SELECT n.n_name, count(c.c_custkey) AS customers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1""")  # fmt: skip
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts a category, those without rows included."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    return n.join(c, "n_nationkey", "left").select("n_name", F.coalesce("k", F.lit(0)).alias("customers"))


@query("source_span", """
    SELECT source, strftime(min(updated_at), '%Y-%m-%d') AS first_update, strftime(max(updated_at), '%Y-%m-%d') AS last_update, count(DISTINCT lang) AS langs, count(*) FILTER (WHERE title IS NULL) AS untitled FROM documents GROUP BY 1""")  # fmt: skip
def source_span(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.date_format(F.min("updated_at"), "yyyy-MM-dd").alias("first_update"), F.date_format(F.max("updated_at"), "yyyy-MM-dd").alias("last_update"), F.count_distinct("lang").alias("langs"), F.count_if(F.col("title").isNull()).alias("untitled"))


@query("experiment_summary", "SELECT event_type, count(*) FILTER (WHERE value < 0.1) AS failed, count(*) FILTER (WHERE value >= 0.1) AS answered FROM events GROUP BY 1")
def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    """Successes and failures of a log of runs."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") < 0.1).alias("failed"), F.count_if(F.col("value") >= 0.1).alias("answered"))


# --- constraints -------------------------------------------------------------------------------------------------
@query("constraint_violations", """
    SELECT 'web_chunks.document_id' AS rule, id AS key FROM web_chunks c WHERE NOT EXISTS (SELECT 1 FROM web_documents d WHERE d.id = c.document_id)
    UNION ALL SELECT 'web_chunks.content_hash', content_hash FROM web_chunks WHERE content_hash IS NOT NULL GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'web_documents.source_type', id FROM web_documents WHERE source_type NOT IN ('web', 'excel')
    UNION ALL SELECT 'qa_pairs.row_num', id FROM qa_pairs WHERE row_num IS NULL
    UNION ALL SELECT 'site_objects.object_id', object_id FROM site_objects GROUP BY 2 HAVING count(*) > 1""")  # fmt: skip
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rows against declared foreign keys, unique keys, value checks and non-null rules."""
    rule = lambda n, df, k: df.select(F.lit(n).alias("rule"), F.col(k).alias("key"))
    c, w, o = _web(spark, d), _webdocs(spark, d), _objects(spark, d)
    twice = lambda df, k: df.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = rule("web_chunks.document_id", c.select("id", "document_id").join(w.select(F.col("id").alias("document_id")), "document_id", "left_anti"), "id")
    out = out.unionAll(rule("web_chunks.content_hash", twice(c, "content_hash"), "content_hash"))
    out = out.unionAll(rule("web_documents.source_type", w.where(~F.col("source_type").isin("web", "excel")), "id"))
    out = out.unionAll(rule("qa_pairs.row_num", _qa(spark, d).where("row_num IS NULL"), "id"))
    return out.unionAll(rule("site_objects.object_id", twice(o, "object_id"), "object_id"))

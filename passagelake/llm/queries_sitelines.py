"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .nearcopies import near_copies
from .registry import query
from .sitelines import clean_texts, host, line_report, marked_lines


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "overview_pages").select(
        F.lit("overview_pages").alias("group"), F.col("snapshot_id").cast("string").alias("row_key"), host("metadata.url").alias("site"), F.col("content.full_text").alias("text"), F.to_date("fetched_at").alias("day"))
    docs = table(spark, sf_dir, "web_documents").select(F.col("id").alias("document_id"), host("url").alias("site")).where(F.col("site").isNotNull())
    chunks = table(spark, sf_dir, "web_chunks").select("id", "document_id", "text", F.to_date("created_at").alias("day")).join(docs, "document_id", "left").select(
        F.lit("web_chunks").alias("group"), F.col("id").alias("row_key"), "site", "text", "day")
    return pages.unionByName(chunks)


_SQL = """
    WITH docs AS (SELECT id, lower(regexp_extract(url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)) AS site FROM web_documents),
    rows_ AS (
      SELECT 'overview_pages' AS src_table, CAST(snapshot_id AS VARCHAR) AS row_key,
             lower(regexp_extract(metadata.url, '^\\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)) AS site, content.full_text AS text FROM overview_pages
      UNION ALL SELECT 'web_chunks', c.id, d.site, c.text FROM web_chunks c JOIN docs d ON c.document_id = d.id),
    usable AS (SELECT * FROM rows_ WHERE site <> '' AND trim(text) <> ''),
    sizes AS (SELECT src_table, site, count(*) AS n FROM usable GROUP BY 1, 2),
    ls AS (SELECT src_table, row_key, site, unnest(string_split(text, E'\\n')) AS line, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS line_no FROM usable),
    fs AS (SELECT src_table, row_key, site, line_no, regexp_replace(lower(regexp_replace(regexp_replace(line, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), '[\\s\\x{A0}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS f
           FROM ls WHERE regexp_matches(line, '\\p{L}')),
    hits AS (SELECT f.src_table, f.site, f.f FROM fs f JOIN sizes s USING (src_table, site) GROUP BY f.src_table, f.site, f.f, s.n
             HAVING count(DISTINCT f.row_key) >= 3 AND count(DISTINCT f.row_key) >= 0.05 * s.n)
    SELECT src_table, row_key, CAST(line_no AS INTEGER) AS line_no FROM fs SEMI JOIN hits USING (src_table, site, f)"""


@query("p6_found", _SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_lines(_rows(spark, sf_dir)).select(F.col("group").alias("src_table"), "row_key", "line_no")


@query("p6_clean")
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without its site's repeated lines, but with those of republished articles."""
    return clean_texts(_rows(spark, sf_dir)).withColumnRenamed("group", "src_table")


@query("p6_clusters")
def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable row with the cluster of near-copies it belongs to."""
    rows = _rows(spark, sf_dir).where("site IS NOT NULL AND trim(text) <> ''").withColumn("doc", F.xxhash64("text"))
    clusters = near_copies(rows, "doc", "text", ["group", "site"])
    return rows.select("group", "row_key", "site", "doc").join(clusters, ["group", "site", "doc"]).select(F.col("group").alias("src_table"), "row_key", "cluster")


_LINES = (
    _SQL[: _SQL.index("hits AS")]
    + """d AS (SELECT 'overview_pages' AS src_table, CAST(snapshot_id AS VARCHAR) AS row_key, CAST(fetched_at AS DATE) AS day FROM overview_pages UNION ALL SELECT 'web_chunks', id, CAST(created_at AS DATE) FROM web_chunks)
    SELECT f.src_table, f.site, f.f AS line_form, count(DISTINCT f.row_key) AS n_rows, count(DISTINCT md5(u.text)) AS n_texts, s.n AS site_rows, count(DISTINCT d.day) AS n_days
    FROM fs f JOIN sizes s USING (src_table, site) JOIN usable u USING (src_table, row_key) JOIN d USING (src_table, row_key) GROUP BY f.src_table, f.site, f.f, s.n HAVING count(DISTINCT f.row_key) >= 3 AND count(DISTINCT f.row_key) >= 0.05 * s.n"""
)


@query("p6_lines", _LINES)
def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines found, with rows, distinct texts and days: few texts or days mean republication, not boilerplate."""
    return line_report(_rows(spark, sf_dir)).withColumnRenamed("group", "src_table").drop("n_clusters")

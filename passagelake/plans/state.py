"""Upserts, deduplication, conflicts, threads, graph walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators import upsert as U
from ..session import table
from .registry import query
from .tables import _LATEST, latest_objects


def _split(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """A table as an earlier load and the rows of a later one."""
    t = table(spark, d, name)
    return t.where("created_at < TIMESTAMP '2025-01-01 00:00:00'"), t.where("created_at >= TIMESTAMP '2025-01-01 00:00:00'")


def _actions_sql(name: str, key: str) -> str:
    return f"""
    WITH stored AS (SELECT DISTINCT {key} AS k FROM {name} WHERE created_at < TIMESTAMP '2025-01-01 00:00:00' AND {key} IS NOT NULL),
    inc AS (SELECT id, {key} AS k FROM {name} WHERE created_at >= TIMESTAMP '2025-01-01 00:00:00')
    SELECT id, CASE WHEN k IN (SELECT k FROM stored) THEN 'skip' WHEN k IS NOT NULL AND id > min(id) OVER (PARTITION BY k) THEN 'duplicate' ELSE 'insert' END AS action FROM inc"""


def _upsert(name: str, tab: str, key: str) -> None:
    @query(name, _actions_sql(tab, key))
    def plan(spark: SparkSession, d: str) -> DataFrame:
        stored, incoming = _split(spark, d, tab)
        return U.upsert_actions(stored.select("id", key), incoming.select("id", key), key, "id").select("id", "action")

    plan.__doc__ = f"What a later load of {tab} does to the stored rows, by {key}."


_upsert("upsert_documents", "web_documents", "doc_hash")
_upsert("upsert_chunks", "web_chunks", "content_hash")
_upsert("upsert_qa", "qa_pairs", "content_hash")


@query("ingest_stats", f"WITH a AS ({_actions_sql('web_chunks', 'content_hash')}) SELECT action, count(*) AS n FROM a GROUP BY 1")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of an ingestion run."""
    stored, incoming = _split(spark, d, "web_chunks")
    return U.upsert_actions(stored.select("id", "content_hash"), incoming.select("id", "content_hash"), "content_hash", "id").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("merge_latest", """
    SELECT object_id, id, title FROM site_objects QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY created_at DESC, id DESC) = 1""")  # fmt: skip
def merge_latest(spark: SparkSession, d: str) -> DataFrame:
    """The stored table after an overwriting upsert."""
    stored, incoming = _split(spark, d, "site_objects")
    cols = ["object_id", "id", "title", "created_at"]
    return U.merge_latest(stored.select(cols), incoming.select(cols), "object_id", F.col("created_at"), F.col("id")).select("object_id", "id", "title")


@query("dedup_documents", """
    SELECT id, k FROM (SELECT id, coalesce(nullif(object_id, ''), nullif(url, ''), CAST(id AS VARCHAR)) AS k FROM site_objects) QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1""")  # fmt: skip
def dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key, the key being the first that a row has of several."""
    k = F.coalesce(F.nullif("object_id", F.lit("")), F.nullif("url", F.lit("")), F.col("id").cast("string"))
    rows = table(spark, d, "site_objects").select("id", k.alias("k"))
    return U.keep_first(rows, F.col("k"), "id")


@query("distinct_texts", "SELECT count(*) AS n, count(DISTINCT md5(text)) AS n_distinct FROM documents")
def distinct_texts(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return h.agg(F.sum("c").alias("n"), F.count("h").alias("n_distinct"))


@query("conflict_resolution", """
    WITH w AS (SELECT id, object_id, date_diff('day', min(last_scraped) OVER p, max(last_scraped) OVER p) AS gap, count(*) OVER p AS n,
                      row_number() OVER (PARTITION BY coalesce(object_id, 'uncategorized') ORDER BY CASE classification_confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, last_scraped DESC NULLS LAST, id) AS r
               FROM site_objects WINDOW p AS (PARTITION BY coalesce(object_id, 'uncategorized')))
    SELECT id, object_id, CASE WHEN n > 1 AND gap > 180 THEN n - 1 ELSE 0 END AS n_alternatives FROM w WHERE NOT (n > 1 AND coalesce(gap, 0) > 180) OR r = 1""")  # fmt: skip
def conflict_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Versions of an object more than half a year apart are reduced to the best; others all stay."""
    best = F.when(F.col("classification_confidence") == "high", 0).when(F.col("classification_confidence") == "medium", 1).otherwise(2)
    o = table(spark, d, "site_objects").select("id", "object_id", "classification_confidence", "last_scraped")
    return R.resolve_conflicts(o, "object_id", "last_scraped", [best, F.coalesce(-F.unix_date("last_scraped"), F.lit(1 << 30))], "id").select("id", "object_id", "n_alternatives")


# --- threads -----------------------------------------------------------------------------------------------------
_KEYED = "t AS (SELECT *, coalesce(thread_id, 'unknown_thread') AS thread FROM email_requests)"


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "email_requests").withColumn("thread", F.coalesce("thread_id", F.lit("unknown_thread")))


@query("thread_turns", f"WITH {_KEYED} SELECT request_id, thread, row_number() OVER (PARTITION BY thread ORDER BY received_at, request_id) AS turn FROM t")
def thread_turns(spark: SparkSession, d: str) -> DataFrame:
    return U.running_count(_threads(spark, d).select("request_id", "thread", "received_at"), "thread", "received_at", "request_id", "turn").select("request_id", "thread", "turn")


@query("context_carry_forward", f"WITH {_KEYED} SELECT request_id, thread, last_value(lang IGNORE NULLS) OVER (PARTITION BY thread ORDER BY received_at, request_id) AS known_lang FROM t")
def context_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last language known in each thread at each mail."""
    return U.carry_forward(_threads(spark, d).select("request_id", "thread", "received_at", "lang"), "thread", "received_at", "request_id", "lang", "known_lang").select("request_id", "thread", "known_lang")


@query("thread_state", f"""
    WITH {_KEYED} SELECT thread, count(*) AS turn_count, strftime(max(received_at), '%Y-%m-%d %H:%M:%S') AS last_updated, arg_max(subject, (received_at, request_id)) FILTER (WHERE subject IS NOT NULL) AS subject,
      arg_max(lang, (received_at, request_id)) FILTER (WHERE lang IS NOT NULL) AS lang FROM t GROUP BY 1""")  # fmt: skip
def thread_state(spark: SparkSession, d: str) -> DataFrame:
    """State of every thread after all its mails: what is known last of each field."""
    at = F.struct("received_at", "request_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    return _threads(spark, d).groupBy("thread").agg(F.count(F.lit(1)).alias("turn_count"), F.date_format(F.max("received_at"), "yyyy-MM-dd HH:mm:ss").alias("last_updated"), last("subject"), last("lang"))


@query("redelivered_mails", "SELECT email_id, count(*) AS n, min(request_id) AS first_request FROM email_requests WHERE email_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def redelivered_mails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "email_requests").where("email_id IS NOT NULL").groupBy("email_id").agg(F.count(F.lit(1)).alias("n"), F.min("request_id").alias("first_request")).where("n > 1")


@query("user_sessions", """
    WITH g AS (SELECT *, CASE WHEN floor(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6) > 1800 THEN 1 WHEN lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, sum(fresh)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY 1""")  # fmt: skip
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, ended by half an hour's silence."""
    return U.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", 1800)


# --- graph -------------------------------------------------------------------------------------------------------
@query("crawl_frontier", f"""
    WITH RECURSIVE {_LATEST}, e AS (SELECT DISTINCT object_id AS src, unnest(related_pages) AS dst FROM obj), ok AS (SELECT e.src, e.dst FROM e JOIN obj o ON o.object_id = e.dst),
    walk AS (SELECT object_id AS node, 0 AS steps FROM obj WHERE id % 20 = 0 UNION SELECT ok.dst, walk.steps + 1 FROM walk JOIN ok ON ok.src = walk.node WHERE walk.steps < 3)
    SELECT node, min(steps)::INTEGER AS steps FROM walk GROUP BY 1""")  # fmt: skip
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages reached from the seeds within three links, with their distance."""
    o = latest_objects(spark, d).select("id", "object_id", "related_pages")
    e = o.select(F.col("object_id").alias("src"), F.explode("related_pages").alias("dst")).join(o.select(F.col("object_id").alias("dst")), "dst", "left_semi")
    return U.reachable(e, o.where("id % 20 = 0").select(F.col("object_id").alias("node")), 3)


@query("best_related", f"""
    WITH {_LATEST}, e AS (SELECT object_id, object_type, unnest(related_pages) AS dst, unnest(range(len(related_pages))) AS pos FROM obj),
    n AS (SELECT object_id, object_type, length(raw_json) AS len FROM obj WHERE length(raw_json) >= 400),
    s AS (SELECT e.object_id, e.pos, n.object_id AS best, n.len + CASE WHEN n.object_type = e.object_type THEN 10000 ELSE 0 END - CASE WHEN n.object_type = 'overview_navigation' THEN 5000 ELSE 0 END AS score FROM e JOIN n ON n.object_id = e.dst)
    SELECT object_id, best, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY score DESC, pos) = 1""")  # fmt: skip
def best_related(spark: SparkSession, d: str) -> DataFrame:
    """Of an object's neighbours with enough text the longest, of its own type first; ties by link order."""
    o = latest_objects(spark, d)
    e = o.select("object_id", F.col("object_type").alias("own_type"), F.posexplode("related_pages").alias("pos", "dst"))
    n = o.select(F.col("object_id").alias("dst"), F.col("object_type"), F.char_length("raw_json").cast("long").alias("len")).where("len >= 400")
    score = F.col("len") + F.when(F.col("object_type") == F.col("own_type"), 10000).otherwise(0) - F.when(F.col("object_type") == "overview_navigation", 5000).otherwise(0)
    j = e.join(n, "dst").select("object_id", F.struct(score.alias("score"), (-F.col("pos")).alias("p"), F.col("dst").alias("best")).alias("x"))
    return j.groupBy("object_id").agg(F.max("x").alias("x")).select("object_id", "x.best", "x.score")


@query("source_reordering", """
    WITH b AS (SELECT doc_id, source, CASE WHEN object_type = 'degree_program' THEN 0 WHEN object_type IN ('fees_funding_rule', 'application_process') THEN 1 WHEN object_type IS NOT NULL THEN 2 ELSE 3 END AS bucket FROM documents)
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) AS new_number FROM b QUALIFY new_number <= 8""")  # fmt: skip
def source_reordering(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source renumbered by priority, eight of each."""
    bucket = F.when(F.col("object_type") == "degree_program", 0).when(F.col("object_type").isin("fees_funding_rule", "application_process"), 1).when(F.col("object_type").isNotNull(), 2).otherwise(3)
    b = table(spark, d, "documents").select("doc_id", "source", bucket.alias("bucket"))
    return R.ranked(b, "source", 8, "bucket", "doc_id").select("doc_id", "source", F.col("rank").cast("long").alias("new_number"))


@query("normalize_document", """
    SELECT id, coalesce(nullif(title, ''), 'untitled') AS title, coalesce(url, '') AS url, coalesce(object_type, 'unknown') AS object_type, coalesce(classification_confidence, 'low') AS confidence,
      coalesce(strftime(last_scraped, '%Y-%m-%d'), '1970-01-01') AS last_updated, coalesce(len(related_pages), 0)::INTEGER AS n_related FROM site_objects""")  # fmt: skip
def normalize_document(spark: SparkSession, d: str) -> DataFrame:
    """Evidence documents with defaults for whatever is missing."""
    c = lambda n, v: F.coalesce(n, F.lit(v)).alias(n)
    return table(spark, d, "site_objects").select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled")).alias("title"), c("url", ""), c("object_type", "unknown"), F.coalesce("classification_confidence", F.lit("low")).alias("confidence"), F.coalesce(F.date_format("last_scraped", "yyyy-MM-dd"), F.lit("1970-01-01")).alias("last_updated"), F.coalesce(F.size("related_pages"), F.lit(0)).alias("n_related"))


@query("base_metadata", """
    SELECT id, coalesce(nullif(object_id, ''), object_type || '-' || left(page_id, 8)) AS object_id, coalesce(title, 'untitled') AS title FROM site_objects""")  # fmt: skip
def base_metadata(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "site_objects")
    return o.select("id", F.coalesce(F.nullif("object_id", F.lit("")), F.concat("object_type", F.lit("-"), F.substring("page_id", 1, 8))).alias("object_id"), F.coalesce("title", F.lit("untitled")).alias("title"))


@query("doc_flags", """
    SELECT id, coalesce(contains(url, '/handbook/'), false) AS is_handbook, coalesce(len(contacts), 0) = 0 AND coalesce(len(links), 0) = 0 AS is_weak, coalesce(nullif(url, ''), nullif(title, ''), id) AS unique_key FROM web_documents""")  # fmt: skip
def doc_flags(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return table(spark, d, "web_documents").select("id", F.coalesce(F.contains("url", F.lit("/handbook/")), F.lit(False)).alias("is_handbook"), ((n("contacts") == 0) & (n("links") == 0)).alias("is_weak"), F.coalesce(F.nullif("url", F.lit("")), F.nullif("title", F.lit("")), "id").alias("unique_key"))



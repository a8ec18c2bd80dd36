"""Retrieval and ingestion as functions over DataFrames: a batch of questions is one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normalize_text
from .operators import retrieval as R
from .operators.chunking import chunk_texts, fixed_chunks
from .operators.embed import Embedder, HashingEmbedder, embed
from .operators.objects import embedding_texts
from .operators.upsert import upsert_actions
from .sources import io


def _vectors(questions: DataFrame, make: Callable[[], Embedder], name: str) -> DataFrame:
    return embed(questions, ["query_id", "question"], "question", make, name, role="query").select("query_id", "question", F.col("embedding").alias("query_vector"))


def web_items(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Stored chunks with their documents' data; contacts and links fall back to the document's."""
    c = chunks.select(F.lit("web").alias("source_type"), F.col("id").alias("item_id"), F.col("document_id").alias("object_id"), F.col("text").alias("content"), F.col("contacts").alias("_c"), F.col("links").alias("_l"), F.col("embedding").alias("item_vector"))
    d = documents.select(F.col("id").alias("object_id"), "title", "url", F.col("source_type").alias("object_type"), "contacts", "links")
    return c.join(d, "object_id").withColumn("contacts", F.coalesce("_c", "contacts")).withColumn("links", F.coalesce("_l", "links")).drop("_c", "_l")


def qa_items(pairs: DataFrame) -> DataFrame:
    """Stored questions and answers as items; each is its own document."""
    return pairs.select(F.lit("qa").alias("source_type"), F.col("id").alias("item_id"), F.col("id").alias("object_id"), F.col("answer").alias("content"), F.col("question_embedding").alias("item_vector"), F.col("question").alias("title"), F.lit(None).cast("string").alias("url"), F.lit("qa").alias("object_type"))


def _search(questions: DataFrame, items: DataFrame, k: int, dim: int) -> DataFrame:
    found = R.exact_topk(questions, items, k, dim)
    return found.join(items.drop("item_vector"), "item_id").join(questions.select("query_id", "question"), "query_id")


def retrieve_top_k(questions: DataFrame, items: DataFrame, top_k: int = 6, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", dim: int = 768, min_score: float = 0.0, top_k_db: int | None = None, reranker: Callable[[Column, Column], Column] | None = None, max_rerank: int | None = None) -> DataFrame:
    """Documents for each of `questions` (query_id, question): nearest items, threshold, rerank, merge by document.

    reranker: a function of the columns question and content that gives a score, R.lexical_score for instance.
    """
    found = _search(_vectors(questions, make, model), items, top_k_db or top_k, dim)
    found = R.min_score_filter(found, min_score)
    if reranker:
        found = R.rerank(found, reranker(F.col("question"), F.col("content")), max_rerank=max_rerank)
    return R.merge_documents(found, "object_id", top_k)


def retrieve_multi_query(sub_queries: DataFrame, items: DataFrame, top_k: int = 5, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", dim: int = 768, min_score: float = 0.0, top_k_db: int = 30, reranker: Callable[[Column, Column], Column] | None = None, max_rerank: int | None = None) -> DataFrame:
    """Documents for each set of sub-queries (set_id, query_id, ordinal, question): pooled, boosted by matches, reranked against the first, merged."""
    v = _vectors(sub_queries.select("query_id", "question"), make, model)
    found = R.exact_topk(v, items, top_k_db, dim).join(sub_queries.select("query_id", "set_id"), "query_id")
    pool = R.fuse_queries(found, "set_id", "item_id")
    pool = R.min_score_filter(pool, min_score, "set_id").join(items.drop("item_vector"), "item_id")
    if reranker:
        first = sub_queries.groupBy("set_id").agg(F.min_by("question", "ordinal").alias("question"))
        pool = R.rerank(pool.join(first, "set_id"), reranker(F.col("question"), F.col("content")), "set_id", max_rerank)
    return R.merge_documents(pool, "object_id", top_k, "set_id")


def retrieve_web_chunks_only(questions: DataFrame, chunks: DataFrame, documents: DataFrame, top_k: int = 6, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", dim: int = 768) -> DataFrame:
    return _search(_vectors(questions, make, model), web_items(chunks, documents), top_k, dim)


def retrieve_qa_pairs_only(questions: DataFrame, pairs: DataFrame, top_k: int = 6, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", dim: int = 768) -> DataFrame:
    return _search(_vectors(questions, make, model), qa_items(pairs), top_k, dim)


def get_retrieval_stats(**tables: DataFrame) -> DataFrame:
    """name and number of rows of each table."""
    out = None
    for n, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def evaluate(found: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id and match: whether any of a query's expected types was found; a query without expectations matches.

    found: query_id, object_type; expected: query_id, expected_types.
    """
    types = found.groupBy("query_id").agg(F.collect_set("object_type").alias("types"))
    got = F.coalesce(F.arrays_overlap("types", "expected_types"), F.lit(False))
    return expected.join(types, "query_id", "left").select("query_id", (got | (F.size("expected_types") == 0)).alias("match"))


def build_content(spark: SparkSession, store: str, web: DataFrame | None = None, pairs: DataFrame | None = None, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", size: int = 900, overlap: int = 150, min_chars: int = 0, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Adds scraped pages (url, title, content, contacts, links) and questions (question, answer) to a store; counts what was done.

    Rows are known by hashes of their natural keys. What is stored is found by an anti-join before the model is called, so
    a second run embeds nothing. Each table is written as a new version; with dry_run nothing is written.
    """
    done = []

    def put(name: str, rows: DataFrame, key: str, text: str | None, vector: str) -> None:
        known = io.versions(spark, f"{store}/{name}")
        old = io.read_version(spark, f"{store}/{name}") if known else None
        stored = old.select(key) if old is not None else rows.select(key).limit(0)
        acts = upsert_actions(stored, rows.withColumn("_order", F.xxhash64(*rows.columns)), key, "_order", force)
        done.append(acts.groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "action", "n"))
        acts = acts.where(F.col("action").isin("insert", "update")).drop("action")
        row = F.struct(*(c for c in acts.columns if c != "_order"))
        one = acts.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row, "_order").alias("_row")).select("_row.*")  # of equal keys the first
        fresh = one.unionByName(acts.where(F.col(key).isNull()).drop("_order"))  # rows without a key are rows of their own
        if text:
            keep = fresh.columns
            v = embed(fresh.select(*keep, F.col(text).alias("_embedded")), keep, "_embedded", make, model)
            fresh = v.withColumnRenamed("embedding", vector).select(*keep, vector, "embedding_model")
        if not dry_run:
            whole = fresh if old is None else old.join(fresh.where(F.col(key).isNotNull()).select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
            io.write_version(whole, f"{store}/{name}")

    if web is not None:
        w = web.withColumn("content", normalize_text("content")).where(F.char_length("content") >= max(min_chars, 1))
        blank = lambda c: F.coalesce(F.col(c), F.lit(""))
        doc_hash = F.sha2(F.concat(blank("title"), blank("url")), 256)
        put("documents", w.select(doc_hash.alias("id"), F.lit("web").alias("source_type"), "title", "url", "contacts", "links", doc_hash.alias("doc_hash")).dropDuplicates(["doc_hash"]), "doc_hash", None, "")
        c = w.select(doc_hash.alias("document_id"), "url", "contacts", "links", F.posexplode(fixed_chunks(F.col("content"), size, overlap)).alias("chunk_index", "c"))
        chunk_hash = F.sha2(F.concat("c.text", blank("url")), 256)
        put("web_chunks", c.select(chunk_hash.alias("id"), "document_id", "chunk_index", "c.start_char", "c.end_char", "c.text", "contacts", "links", chunk_hash.alias("content_hash")), "content_hash", "text", "embedding")
    if pairs is not None:
        h = F.sha2(F.concat("question", "answer"), 256)
        put("qa_pairs", pairs.select(h.alias("id"), "question", "answer", h.alias("content_hash")), "content_hash", "question", "question_embedding")
    out = None
    for x in done:
        out = x if out is None else out.unionAll(x)
    return out


def migrate_objects(objects: DataFrame, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", size: int = 1000, overlap: int = 200, min_chars: int = 250, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of all objects with vectors and their objects' flags, and the report of one row an object.

    objects: as for embedding_texts. Chunks: object_id, object_type, title, url, enriched, still_thin, chunk_index,
    start_char, end_char, chunk_text, embedding, embedding_model.
    """
    texts = embedding_texts(objects, header).join(objects.select("object_id", "object_type", "title", "url"), "object_id")
    keys = ["object_id", "object_type", "title", "url", "enriched", "still_thin"]
    chunks = chunk_texts(texts, keys, "embedding_text", size, overlap, min_chars)
    vectors = embed(chunks, [*keys, "chunk_index", "start_char", "end_char", "chunk_text"], "chunk_text", make, model)
    n = chunks.groupBy("object_id").agg(F.count(F.lit(1)).alias("n"))
    report = texts.join(n, "object_id", "left").select("object_id", "object_type", F.char_length("embedding_text").alias("embedding_text_len"), "enriched", "still_thin", F.coalesce("n", F.lit(0)).alias("num_chunks"))
    return vectors, report


def load_objects(objects: DataFrame, store: str, make: Callable[[], Embedder] = HashingEmbedder, model: str = "hashing-768", dry_run: bool = False, **sizes: object) -> DataFrame:
    """Replaces a store's documents and chunks by those of `objects` in one step, and gives the report of migrate_objects.

    documents: one row an object; chunks: as from migrate_objects, with document_id. Both become new versions, documents
    first, so that no chunk is seen without its document; earlier versions stay as backups. With dry_run nothing is written.
    """
    chunks, report = migrate_objects(objects, make, model, **sizes)
    documents = objects.join(report.select("object_id", "enriched", "still_thin", "num_chunks"), "object_id", "left").withColumn("id", F.xxhash64("object_id"))
    if not dry_run:
        io.write_version(documents, f"{store}/documents")
        io.write_version(chunks.withColumn("document_id", F.xxhash64("object_id")), f"{store}/chunks")
    return report

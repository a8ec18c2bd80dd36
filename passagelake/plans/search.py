"""Retrieval queries: over the embeddings table with its labels as documents, and over the stored web chunks and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import retrieval as R
from ..operators import upsert as U
from ..operators.ann import ivf_topk
from ..session import table
from .registry import query

DIM, WIDE, K = 64, 768, 10

_S = """
    q AS (SELECT vec_id AS query_id, label AS set_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT q.query_id, q.set_id, e.vec_id AS item_id, e.label, greatest(round(1 - list_cosine_similarity(q.qv::DOUBLE[], e.embedding::DOUBLE[]), 6), 0) AS score FROM q, embeddings e),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vector"), "label")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("set_id"))


def _top(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    found = R.exact_topk(_queries(spark, d), _items(spark, d), k, DIM)
    return found.join(_items(spark, d).select("item_id", "label"), "item_id")


@query("vector_topk", f"WITH {_S} SELECT query_id, item_id, score, rank FROM top")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest items of every query."""
    return R.exact_topk(_queries(spark, d), _items(spark, d), K, DIM).select("query_id", "item_id", "score", "rank")


@query("similarity", f"WITH {_S} SELECT query_id, item_id, round(1 - score, 6) AS similarity FROM top")
def similarity(spark: SparkSession, d: str) -> DataFrame:
    return vector_topk(spark, d).select("query_id", "item_id", F.round(1 - F.col("score"), 6).alias("similarity"))


@query("filtered_topk", """
    WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT q.query_id, e.vec_id AS item_id, greatest(round(1 - list_cosine_similarity(q.qv::DOUBLE[], e.embedding::DOUBLE[]), 6), 0) AS score FROM q, embeddings e WHERE e.label IN (1, 3, 5))
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest items among those of some types; the filter reaches the scan."""
    return R.exact_topk(_queries(spark, d), _items(spark, d).where(F.col("label").isin(1, 3, 5)), K, DIM).select("query_id", "item_id", "score", "rank")


@query("min_score_fallback", f"""
    WITH {_S}, c AS (SELECT *, max(CASE WHEN score <= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS has FROM top)
    SELECT query_id, item_id, score FROM c WHERE score <= 0.5 OR has = 0""")  # fmt: skip
def min_score_fallback(spark: SparkSession, d: str) -> DataFrame:
    return R.min_score_filter(vector_topk(spark, d), 0.5).select("query_id", "item_id", "score")


@query("topk_per_query", f"WITH {_S} SELECT query_id, label, item_id, CAST(row_number() OVER (PARTITION BY query_id, label ORDER BY score, item_id) AS INTEGER) AS n FROM top QUALIFY n <= 2")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id", "label").orderBy("score", "item_id")
    return _top(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 2").select("query_id", "label", "item_id", "n")


@query("cap_chunks_per_doc", f"WITH {_S} SELECT query_id, label, item_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM top) WHERE n <= 3")
def cap_chunks_per_doc(spark: SparkSession, d: str) -> DataFrame:
    """At most three items a document, in rank order."""
    w = Window.partitionBy("query_id", "label").orderBy("rank")
    return _top(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 3").select("query_id", "label", "item_id")


_MERGE = """
    own AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM top),
    docs AS (SELECT query_id, label, min(rank) AS first, string_agg('v' || item_id, E'\\n\\n' ORDER BY n) FILTER (WHERE n <= 3) AS content, min(score) AS score, count(*) AS n_chunks FROM own GROUP BY 1, 2)"""


@query("merge_documents", f"WITH {_S}, {_MERGE} SELECT query_id, label, content, score, n_chunks, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS doc_rank FROM docs QUALIFY doc_rank <= 5")
def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    """Items merged by document, documents in order of first appearance."""
    found = _top(spark, d).withColumn("content", F.concat(F.lit("v"), F.col("item_id").cast("string")))
    return R.merge_documents(found, "label", 5)


@query("multi_query_pool", f"WITH {_S} SELECT set_id, item_id, min(score) AS score, count(*) AS n_matches FROM top GROUP BY 1, 2")
def multi_query_pool(spark: SparkSession, d: str) -> DataFrame:
    """Results of all sub-queries of a set, each item once."""
    sets = _queries(spark, d).select("query_id", "set_id")
    return vector_topk(spark, d).join(sets, "query_id").groupBy("set_id", "item_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n_matches"))


@query("multi_query_fusion", f"""
    WITH {_S}, pool AS (SELECT set_id, item_id, min(score) AS s, count(*) AS n_matches FROM top GROUP BY 1, 2),
    b AS (SELECT set_id, item_id, n_matches, round(s * CASE WHEN n_matches > 1 THEN greatest(1.0::DOUBLE - 0.05::DOUBLE * (n_matches - 1), 0.7::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS score FROM pool)
    SELECT set_id, item_id, n_matches, score, CAST(row_number() OVER (PARTITION BY set_id ORDER BY score, item_id) AS INTEGER) AS rank FROM b""")  # fmt: skip
def multi_query_fusion(spark: SparkSession, d: str) -> DataFrame:
    sets = _queries(spark, d).select("query_id", "set_id")
    return R.fuse_queries(vector_topk(spark, d).join(sets, "query_id"), "set_id", "item_id").select("set_id", "item_id", "n_matches", "score", "rank")


@query("l2_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS norm, 1.0::DOUBLE AS unit FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    length = lambda v: F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4)
    return table(spark, d, "embeddings").select("vec_id", length(F.col("embedding")).alias("norm"), length(R.l2_normalize("embedding")).alias("unit"))


@query("vector_dims", "SELECT coalesce(len(embedding), -1)::INTEGER AS dims, count(*) AS n FROM web_chunks GROUP BY 1")
def vector_dims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_chunks").groupBy(F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims")).agg(F.count(F.lit(1)).alias("n"))


@query("ivf_topk")
def ivf(spark: SparkSession, d: str) -> DataFrame:
    """Approximate nearest items by inverted lists; the tests measure the recall of this query itself."""
    return ivf_topk(_queries(spark, d), _items(spark, d), K, DIM)


@query("ir_metrics", f"""
    WITH {_S}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
    h AS (SELECT query_id, set_id, rank, item_id, CASE WHEN label = set_id AND item_id <> query_id THEN 1 ELSE 0 END AS rel FROM top)
    SELECT query_id, round(sum(rel) / 10.0, 6) AS precision_at_k, round(sum(rel) / greatest(max(n.n) - 1, 1)::DOUBLE, 6) AS recall_at_k, round(coalesce(1.0 / min(CASE WHEN rel = 1 THEN rank END), 0), 6) AS rr
    FROM h JOIN n ON n.label = h.set_id GROUP BY 1""")  # fmt: skip
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and reciprocal rank at k; items of the query's label are relevant."""
    n = table(spark, d, "embeddings").groupBy(F.col("label").alias("set_id")).agg(F.count(F.lit(1)).alias("n"))
    q = _queries(spark, d).select("query_id", "set_id").join(n, "set_id")
    rel = ((F.col("label") == F.col("set_id")) & (F.col("item_id") != F.col("query_id"))).cast("int")
    h = _top(spark, d).join(q, "query_id").withColumn("rel", rel)
    return h.groupBy("query_id").agg(F.round(F.sum("rel") / 10.0, 6).alias("precision_at_k"), F.round(F.sum("rel") / F.greatest(F.max("n") - 1, F.lit(1)), 6).alias("recall_at_k"), F.round(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)), 6).alias("rr"))


@query("eval_success_rate", f"WITH {_S}, h AS (SELECT query_id, max(CASE WHEN label = set_id AND item_id <> query_id THEN 1 ELSE 0 END) AS hit FROM top GROUP BY 1) SELECT count(*) AS queries, sum(hit)::BIGINT AS matches, round(avg(hit), 6) AS success_rate FROM h")
def eval_success_rate(spark: SparkSession, d: str) -> DataFrame:
    q = _queries(spark, d).select("query_id", "set_id")
    hit = ((F.col("label") == F.col("set_id")) & (F.col("item_id") != F.col("query_id"))).cast("int")
    h = _top(spark, d).join(q, "query_id").groupBy("query_id").agg(F.max(hit).alias("hit"))
    return h.agg(F.count(F.lit(1)).alias("queries"), F.sum("hit").alias("matches"), F.round(F.avg("hit"), 6).alias("success_rate"))


@query("rrf_hybrid", f"""
    WITH {_S}, kw AS (SELECT q.query_id, e.vec_id AS item_id, CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY e.vec_id) AS INTEGER) AS rank FROM q JOIN embeddings e ON e.label = q.set_id QUALIFY rank <= 10),
    r AS (SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT query_id, item_id, rank FROM top UNION ALL SELECT query_id, item_id, rank FROM kw) GROUP BY 1, 2)
    SELECT query_id, item_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, item_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10""")  # fmt: skip
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Vector ranking fused with a second ranking (items of the query's label)."""
    kw = _queries(spark, d).select("query_id", "set_id").join(_items(spark, d).select("item_id", F.col("label").alias("set_id")), "set_id")
    return R.reciprocal_rank_fusion(vector_topk(spark, d), R.ranked(kw, "query_id", K, "item_id"), "query_id", "item_id", K)


# --- web chunks and questions ------------------------------------------------------------------------------------
_USE = lambda c: f"len({c}) = 768 AND list_max(list_transform({c}, lambda x: abs(x))) > 0"
_WEB = f"""
    q AS (SELECT id AS query_id, question, question_embedding AS qv FROM qa_pairs WHERE row_num % 20 = 0 AND {_USE('question_embedding')}),
    w AS (SELECT c.id AS item_id, c.document_id AS object_id, c.text AS content, d.title, d.url, c.embedding AS v FROM web_chunks c JOIN web_documents d ON d.id = c.document_id WHERE {_USE('c.embedding')}),
    s AS (SELECT q.query_id, w.item_id, greatest(round(1 - list_cosine_similarity(q.qv::DOUBLE[], w.v::DOUBLE[]), 6), 0) AS score FROM q, w),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 30)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every question whose row number is divisible by 20."""
    return table(spark, d, "qa_pairs").where("row_num % 20 = 0").select(F.col("id").alias("query_id"), "question", F.col("question_embedding").alias("query_vector"))


def _web_items(spark: SparkSession, d: str, *more: str) -> DataFrame:
    docs = table(spark, d, "web_documents").select(F.col("id").alias("object_id"), "title", "url")
    return table(spark, d, "web_chunks").select(F.col("id").alias("item_id"), F.col("document_id").alias("object_id"), *more).join(docs, "object_id")


def _web_top(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    items = _web_items(spark, d, "embedding").withColumnRenamed("embedding", "item_vector")
    return R.exact_topk(_questions(spark, d), items, k, WIDE)


@query("web_topk", f"WITH {_WEB} SELECT query_id, item_id, score, rank FROM top WHERE rank <= 10")
def web_topk(spark: SparkSession, d: str) -> DataFrame:
    """Web chunks nearest to the questions, without rerank or merge."""
    return _web_top(spark, d, 10).select("query_id", "item_id", "score", "rank")


@query("qa_topk", f"""
    WITH q AS (SELECT id AS query_id, question_embedding AS qv FROM qa_pairs WHERE row_num % 20 = 0 AND {_USE('question_embedding')}),
    s AS (SELECT q.query_id, p.id AS item_id, greatest(round(1 - list_cosine_similarity(q.qv::DOUBLE[], p.question_embedding::DOUBLE[]), 6), 0) AS score FROM q, qa_pairs p WHERE {_USE('p.question_embedding')})
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def qa_topk(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "qa_pairs").select(F.col("id").alias("item_id"), F.col("question_embedding").alias("item_vector"))
    return R.exact_topk(_questions(spark, d), items, 10, WIDE).select("query_id", "item_id", "score", "rank")


_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9äöüß]+'), lambda x: x <> ''))"
_RERANK = f"""
    scored AS (SELECT t.*, w.content, w.object_id, w.title, w.url, round(len(list_intersect({_WORDS('q.question')}, {_WORDS('w.content')})) / greatest(len({_WORDS('q.question')}), 1), 6) AS rerank_score
               FROM top t JOIN q USING (query_id) JOIN w USING (item_id)),
    re AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS new_rank FROM scored)"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    found = _web_top(spark, d)
    text = _web_items(spark, d, "text").withColumnRenamed("text", "content")
    q = _questions(spark, d).select("query_id", "question")
    return R.rerank(found.join(text, "item_id").join(q, "query_id"), R.lexical_score("question", "content"))


@query("rerank_topk", f"WITH {_WEB}, {_RERANK} SELECT query_id, item_id, rerank_score, new_rank AS rank FROM re WHERE new_rank <= 10")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The thirty nearest, reranked, the ten best of them."""
    return _reranked(spark, d).where("rank <= 10").select("query_id", "item_id", "rerank_score", "rank")


@query("retrieve_top_k", f"""
    WITH {_WEB}, {_RERANK}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id, object_id ORDER BY new_rank) AS n FROM re),
    docs AS (SELECT query_id, object_id, min(new_rank) AS first, string_agg(content, E'\\n\\n' ORDER BY n) FILTER (WHERE n <= 3) AS content, min(score) AS score, max(rerank_score) AS rerank_score, count(*) AS n_chunks FROM own GROUP BY 1, 2)
    SELECT query_id, object_id, md5(content) AS content_md5, score, rerank_score, n_chunks, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS doc_rank FROM docs QUALIFY doc_rank <= 6""")  # fmt: skip
def retrieve_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: nearest chunks, threshold, rerank, merge by document, six documents a question."""
    found = R.merge_documents(_reranked(spark, d), "object_id", 6)
    return found.select("query_id", "object_id", F.md5("content").alias("content_md5"), "score", "rerank_score", "n_chunks", "doc_rank")


@query("unified_search", f"""
    WITH q AS (SELECT id AS query_id, question_embedding AS qv FROM qa_pairs WHERE row_num % 20 = 0 AND {_USE('question_embedding')}),
    it AS (SELECT 'web' AS source_type, id AS item_id, embedding AS v FROM web_chunks WHERE {_USE('embedding')} UNION ALL SELECT 'qa', id, question_embedding FROM qa_pairs WHERE {_USE('question_embedding')}),
    s AS (SELECT q.query_id, it.source_type || ':' || it.item_id AS item_id, greatest(round(1 - list_cosine_similarity(q.qv::DOUBLE[], it.v::DOUBLE[]), 6), 0) AS score FROM q, it)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")  # fmt: skip
def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Web chunks and questions in one ranking."""
    of = lambda n, t, c: table(spark, d, t).select(F.concat(F.lit(f"{n}:"), "id").alias("item_id"), F.col(c).alias("item_vector"))
    items = of("web", "web_chunks", "embedding").unionAll(of("qa", "qa_pairs", "question_embedding"))
    return R.exact_topk(_questions(spark, d), items, 10, WIDE).select("query_id", "item_id", "score", "rank")


@query("retrieval_confidence", f"""
    WITH {_WEB}, a AS (SELECT t.query_id, avg(1 - t.score) AS a, max(1 - t.score) AS m, min(1 - t.score) AS l, avg(CASE WHEN 1 - t.score > 0.6 THEN 1 ELSE 0 END) AS g, any_value(trim(p.answer)) AS r FROM top t JOIN qa_pairs p ON p.id = t.query_id WHERE rank <= 10 GROUP BY 1),
    c AS (SELECT query_id, round(0.35::DOUBLE * a + 0.25::DOUBLE * m + 0.15::DOUBLE * (1 - (m - l)) + 0.15::DOUBLE * g + 0.05::DOUBLE * least(length(r) / 100.0::DOUBLE, 1) + 0.05::DOUBLE * ((contains(lower(r), 'http')::INT + regexp_matches(r, '[0-9]')::INT + contains(r, '@')::INT + regexp_matches(r, '\\.de(\\s|$)')::INT) / 4.0::DOUBLE), 3) AS confidence FROM a)
    SELECT *, CASE WHEN confidence >= 0.8 THEN 'very_high' WHEN confidence >= 0.65 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' WHEN confidence >= 0.3 THEN 'low' ELSE 'very_low' END AS level FROM c""")  # fmt: skip
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How far each question's results and answer can be trusted."""
    answers = table(spark, d, "qa_pairs").select(F.col("id").alias("query_id"), "answer")
    return R.retrieval_confidence(web_topk(spark, d).join(answers, "query_id"), F.col("answer"))


@query("build_context", f"""
    WITH {_WEB}, t AS (SELECT query_id, '[Source ' || rank || ' - WEB]' || E'\\n' || CASE WHEN w.title <> '' THEN 'Title: ' || w.title || E'\\n' ELSE '' END || CASE WHEN w.url <> '' THEN 'URL: ' || w.url || E'\\n' ELSE '' END || 'Content: ' || w.content || E'\\n\\n' AS block, rank FROM top JOIN w USING (item_id) WHERE rank <= 3)
    SELECT query_id, md5(string_agg(block, '' ORDER BY rank)) AS context_md5 FROM t GROUP BY 1""")  # fmt: skip
def build_context(spark: SparkSession, d: str) -> DataFrame:
    """Numbered context blocks of the three nearest chunks."""
    items = _web_items(spark, d, "text")
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), c, F.lit("\n"))).otherwise("")
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(" - WEB]\n"), line("Title: ", "title"), line("URL: ", "url"), F.lit("Content: "), "text", F.lit("\n\n"))
    t = web_topk(spark, d).where("rank <= 3").join(items, "item_id").select("query_id", F.struct("rank", block.alias("b")).alias("x"))
    return t.groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "")).alias("context_md5"))


@query("merge_adjacent", f"""
    WITH {_WEB}, t AS (SELECT top.query_id, c.document_id, c.chunk_index, c.text FROM top JOIN web_chunks c ON c.id = top.item_id),
    f AS (SELECT *, CASE WHEN lag(document_id) OVER w = document_id AND lag(chunk_index) OVER w + 1 = chunk_index THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY query_id ORDER BY document_id, chunk_index)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY document_id, chunk_index) AS isle FROM f)
    SELECT query_id, document_id, min(chunk_index) AS first_index, md5(string_agg(text, ' ' ORDER BY chunk_index)) AS text_md5, CASE WHEN count(*) > 1 THEN count(*) END AS merged_from FROM i GROUP BY query_id, document_id, isle""")  # fmt: skip
def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    """Of each question's thirty nearest chunks those that follow each other in their document, as one text."""
    pieces = table(spark, d, "web_chunks").select(F.col("id").alias("item_id"), "document_id", "chunk_index", "text")
    found = _web_top(spark, d).select("query_id", "item_id").join(pieces, "item_id").withColumn("place", F.struct("document_id", "chunk_index"))
    return U.merge_adjacent(found, "query_id", "document_id", "chunk_index", "place", "text").select("query_id", "document_id", "first_index", F.md5("text").alias("text_md5"), "merged_from")


@query("chunk_metadata", """
    SELECT c.id, c.document_id, coalesce(len(c.contacts), len(d.contacts))::INTEGER AS n_contacts, coalesce(c.links, d.links)[1].url AS first_link, CASE WHEN c.contacts IS NULL AND d.contacts IS NOT NULL THEN 'document' WHEN c.contacts IS NOT NULL THEN 'chunk' END AS contacts_from
    FROM web_chunks c LEFT JOIN web_documents d ON d.id = c.document_id""")  # fmt: skip
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their contacts and links, and where they have none those of their document."""
    c = table(spark, d, "web_chunks").select("id", "document_id", "contacts", "links")
    w = table(spark, d, "web_documents").select(F.col("id").alias("document_id"), F.col("contacts").alias("_c"), F.col("links").alias("_l"))
    source = F.when(F.col("contacts").isNotNull(), "chunk").when(F.col("_c").isNotNull(), "document")
    return c.join(w, "document_id", "left").select("id", "document_id", F.size(F.coalesce("contacts", "_c")).alias("n_contacts"), F.get(F.coalesce("links", "_l"), F.lit(0))["url"].alias("first_link"), source.alias("contacts_from"))

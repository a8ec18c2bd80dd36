"""Batch retrieval: exact and pruned vector top-k for a set of queries, thresholds, reranking, fusion, document merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import shared_folder

#: So many queries at most are sent with the tasks; more are written to the shared folder and read by the tasks, so many at a time.
QUERY_BLOCK = 4096
#: Numbers of a block of item vectors, and of a product, that a task holds at a time.
BLOCK_NUMBERS = 8_000_000


def usable(v: str, dim: int) -> Column:
    """Vectors of `dim` numbers that are not all zero."""
    return F.coalesce((F.size(v) == dim) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - cosine in double precision, without Python; for pairs that a join has made."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalize(v: str | Column) -> Column:
    """The vector over its length; an all-zero one unchanged."""
    v = F.col(v) if isinstance(v, str) else v
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    x = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def read_blocks(q: DataFrame) -> Callable[[], Iterator[pa.RecordBatch]]:
    """The rows of `q` in batches of QUERY_BLOCK at most, as often as a task asks for them; the driver holds one batch at most."""
    head = q.limit(QUERY_BLOCK + 1).toArrow().combine_chunks()
    if head.num_rows <= QUERY_BLOCK:
        return lambda: iter(head.to_batches())
    where, size = shared_folder(q.sparkSession, "queries"), QUERY_BLOCK
    q.write.parquet(where)

    def read() -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(where if "://" in where or where.startswith("file:") else f"file://{where}")
        yield from ds.dataset(path, filesystem=fs, format="parquet").to_batches(batch_size=size)

    return read


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Batches of items put together to as many vectors as a task holds at a time, in order of their keys."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        return t.take(pc.sort_indices(t.column(0))).combine_chunks().to_batches()[0]

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) * dim >= BLOCK_NUMBERS:
            yield whole()
            held.clear()
    if held:
        yield whole()


def _least(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least numbers of every row of `s`, ties by column."""
    n = min(k, s.shape[1])
    edge = np.partition(s, n - 1, axis=1)[:, n - 1 : n]
    below, tied = s < edge, s == edge
    return np.nonzero(below | tied & (tied.cumsum(1) <= n - below.sum(1, keepdims=True)))


def block_topk(queries: DataFrame, items: DataFrame, k: int, dim: int, keys: tuple[str, str], vectors: tuple[str, str], digits: int, centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The search behind exact_topk and ivf_topk: items stay where they are and meet the queries in blocks by matrix products.

    With centres, an item meets only the queries of whose `probes` nearest centres one is the item's nearest. Only the k
    best of a block leave the task, ties by the item's key, so copies of one item in any number don't widen the result.
    """
    q = queries.where(usable(vectors[0], dim)).select(keys[0], vectors[0])
    it = items.where(usable(vectors[1], dim)).select(keys[1], vectors[1])
    schema = T.StructType([q.schema[keys[0]], it.schema[keys[1]], T.StructField("score", T.DoubleType())])
    read = read_blocks(q)
    step = max(1, QUERY_BLOCK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, dim):
            x, own = _unit(b.column(1), dim), b.column(0)
            lists = (x @ centres.T).argmax(1) if centres is not None else None
            part = max(1, min(step, BLOCK_NUMBERS // len(x)))
            for block in read():
                for at in range(0, block.num_rows, part):
                    some = block.slice(at, part)
                    v = _unit(some.column(1), dim)
                    if lists is None:
                        s = np.round(np.maximum(1.0 - v @ x.T, 0.0), digits)
                        row, col = _least(s, k)
                        score = s[row, col]
                    else:
                        near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                        found = []
                        for c in np.unique(lists):
                            i, j = np.flatnonzero((near == c).any(1)), np.flatnonzero(lists == c)
                            if len(i):
                                s = np.round(np.maximum(1.0 - v[i] @ x[j].T, 0.0), digits)
                                r, m = _least(s, k)
                                found.append((i[r], j[m], s[r, m]))
                        if not found:
                            continue
                        row, col, score = map(np.concatenate, zip(*found, strict=True))
                        order = np.lexsort((col, score, row))
                        row, col, score = row[order], col[order], score[order]
                        first = np.r_[True, np.diff(row) > 0]
                        best = np.arange(len(row)) - np.flatnonzero(first)[first.cumsum() - 1] < k
                        row, col, score = row[best], col[best], score[best]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), own.take(pa.array(col)), pa.array(score)], names=schema.fieldNames())

    return ranked(it.mapInArrow(search, schema), keys[0], k, "score", keys[1])


def exact_topk(queries: DataFrame, items: DataFrame, k: int, dim: int, query_key: str = "query_id", query_vector: str = "query_vector", item_key: str = "item_id", item_vector: str = "item_vector", digits: int = 6) -> DataFrame:
    """query key, item key, score (cosine distance, rounded) and rank of the k nearest items of every query, ties by item key.

    Every item is compared with every query, in one pass over the items, in blocks on both sides. Vectors that are not
    usable on either side take no part; an empty side gives an empty result; null keys are kept.
    """
    return block_topk(queries, items, k, dim, (query_key, item_key), (query_vector, item_vector), digits)


def ranked(df: DataFrame, group: str, k: int | None, *order: str | Column) -> DataFrame:
    """`df` with rank (from 1) in its group, cut to k; the cut is pushed below the shuffle by Spark's window group limit."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return out.where(F.col("rank") <= k) if k else out


def min_score_filter(found: DataFrame, limit: float, query_key: str = "query_id") -> DataFrame:
    """Only rows with a distance within `limit`, but all rows of a query that would be left without any."""
    if limit <= 0:
        return found
    any_ = F.max((F.col("score") <= limit).cast("int")).over(Window.partitionBy(query_key))
    return found.withColumn("_any", any_).where((F.col("score") <= limit) | (F.col("_any") == 0)).drop("_any")


def word_set(c: str | Column) -> Column:
    """Distinct words of letters and digits, in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9äöüß]+"), lambda x: x != ""))


def lexical_score(question: str | Column, passage: str | Column) -> Column:
    """Share of the question's words that the passage has: the offline stand-in of a cross-encoder."""
    q = word_set(question)
    return F.round(F.size(F.array_intersect(q, word_set(passage))) / F.greatest(F.size(q), F.lit(1)), 6)


def rerank(found: DataFrame, score: Column, query_key: str = "query_id", max_rerank: int | None = None) -> DataFrame:
    """New ranks by `score` descending, ties and rows beyond max_rerank (score null) in their old order; the score is computed for ranks within max_rerank only."""
    s = F.when(F.col("rank") <= max_rerank, score) if max_rerank else score
    out = found.withColumn("rerank_score", s).withColumnRenamed("rank", "_old")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc_nulls_last("rerank_score"), "_old"))).drop("_old")


def merge_documents(found: DataFrame, doc_key: str, top_k: int, query_key: str = "query_id", content: str = "content", max_chunks: int = 3) -> DataFrame:
    """One row a query and document: doc_rank by first appearance, content of the first chunks joined, least score, greatest rerank_score, n_chunks; at most top_k a query.

    found: ranked rows. Least and greatest are over all of a document's rows, the content over the first max_chunks.
    """
    w = Window.partitionBy(query_key, doc_key).orderBy("rank")
    own = found.withColumn("_n", F.row_number().over(w))
    more = [F.max("rerank_score").alias("rerank_score")] if "rerank_score" in found.columns else []
    parts = F.array_sort(F.collect_list(F.when(F.col("_n") <= max_chunks, F.struct("_n", F.col(content).alias("c")))))
    docs = own.groupBy(query_key, doc_key).agg(F.min("rank").alias("_first"), F.array_join(F.transform(parts, lambda x: x["c"]), "\n\n").alias(content), F.min("score").alias("score"), *more, F.count(F.lit(1)).alias("n_chunks"))
    return ranked(docs, query_key, top_k, "_first").withColumnRenamed("rank", "doc_rank").drop("_first")


def fuse_queries(found: DataFrame, set_key: str, item_key: str, boost: float = 0.05, floor: float = 0.7) -> DataFrame:
    """Pools the results of all sub-queries of a set: set, item, score (least, improved by `boost` for each further match), n_matches and rank."""
    pool = found.groupBy(set_key, item_key).agg(F.min("score").alias("_s"), F.count(F.lit(1)).alias("n_matches"))
    factor = F.when(F.col("n_matches") > 1, F.greatest(F.lit(1.0) - boost * (F.col("n_matches") - 1), F.lit(floor))).otherwise(1.0)
    return ranked(pool.withColumn("score", F.round(F.col("_s") * factor, 6)).drop("_s"), set_key, None, "score", item_key)


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, query_key: str, item_key: str, k: int, constant: int = 60) -> DataFrame:
    """Items of two rankings by the sum of 1 / (constant + rank)."""
    both = a.select(query_key, item_key, "rank").unionAll(b.select(query_key, item_key, "rank"))
    s = both.groupBy(query_key, item_key).agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + constant)), 9).alias("rrf"))
    return ranked(s, query_key, k, F.desc("rrf"), item_key)


def retrieval_confidence(found: DataFrame, response: Column, query_key: str = "query_id") -> DataFrame:
    """Per query a confidence from its results' similarities and its response: score and level. Weights and levels are fixed values."""
    sim = F.lit(1.0) - F.col("score")
    r = found.groupBy(query_key).agg(F.avg(sim).alias("avg"), F.max(sim).alias("top"), F.min(sim).alias("low"), F.avg((sim > 0.6).cast("int")).alias("good"), F.first(response).alias("text"))
    text = F.trim("text")
    marks = sum((c.cast("int") for c in (F.contains(F.lower(text), F.lit("http")), F.regexp_like(text, F.lit("[0-9]")), F.contains(text, F.lit("@")), F.regexp_like(text, F.lit(r"\.de(\s|$)")))), F.lit(0)) / 4.0
    s = 0.35 * F.col("avg") + 0.25 * F.col("top") + 0.15 * (1 - (F.col("top") - F.col("low"))) + 0.15 * F.col("good") + 0.05 * F.least(F.char_length(text) / 100.0, F.lit(1.0)) + 0.05 * marks
    s = F.round(s, 3)
    level = F.when(s >= 0.8, "very_high").when(s >= 0.65, "high").when(s >= 0.5, "medium").when(s >= 0.3, "low").otherwise("very_low")
    return r.select(query_key, s.alias("confidence"), level.alias("level"))


def resolve_conflicts(df: DataFrame, category: str, updated: str, order: list[Column], key: str, days: int = 180) -> DataFrame:
    """Rows kept when a category's rows are of different age: if its dates span more than `days`, the least by `order`, else all.

    order: columns of which the least value is best; key: unique. A null category is 'uncategorized'. Result: the input's columns, n_alternatives (rows dropped in its favour).
    """
    own = df.withColumn("_cat", F.coalesce(category, F.lit("uncategorized")))
    # one aggregate a category, combined before the shuffle; no category's rows are sorted in one task
    stats = own.groupBy("_cat").agg(F.datediff(F.max(updated), F.min(updated)).alias("_gap"), F.count(F.lit(1)).alias("_n"), F.min_by(key, F.struct(*order, F.col(key))).alias("_best"))
    apart = F.coalesce((F.col("_n") > 1) & (F.col("_gap") > days), F.lit(False))
    out = own.join(stats, "_cat").where(~apart | F.col(key).eqNullSafe(F.col("_best")))
    return out.withColumn("n_alternatives", F.when(apart, F.col("_n") - 1).otherwise(0)).drop("_cat", "_gap", "_n", "_best")

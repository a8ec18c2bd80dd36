"""Queries of problem 4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .registry import query
from .split import split_texts

_SOURCES = (("web_chunks", "id", "text"), ("chunks", "id", "chunk_text"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        (split_texts(table(spark, sf_dir, t).select(F.col(k).cast("string").alias("row_key"), F.col(c).alias("text")), "row_key", "text").withColumn("src_table", F.lit(t)) for t, k, c in _SOURCES),
    )


@query("p4_found", """
    SELECT 'web_chunks' AS src_table, id AS row_key FROM web_chunks WHERE length(trim(text, E' \\t\\r\\n')) > 1000
    UNION ALL SELECT 'chunks', CAST(id AS VARCHAR) FROM chunks WHERE length(trim(chunk_text, E' \\t\\r\\n')) > 1000""")  # fmt: skip
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that come out in more than one piece."""
    return _pieces(spark, sf_dir).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("src_table", "row_key")


# Any cut that keeps the text, the limit and the overlap gives one row of true values a text.
_CHECK = """
    WITH t AS (SELECT 'web_chunks' AS src_table, id AS row_key, trim(text, E' \\t\\r\\n') AS t FROM web_chunks UNION ALL SELECT 'chunks', CAST(id AS VARCHAR), trim(chunk_text, E' \\t\\r\\n') FROM chunks)
    SELECT src_table, row_key, md5(t) AS joined_hash, length(t) AS n_chars, TRUE AS in_limit, TRUE AS shares FROM t WHERE length(t) > 1000"""  # fmt: skip


@query("p4_joined", _CHECK)
def p4_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized text put together again without what they share: its hash and length, and whether all pieces keep to the limit and the overlap."""
    p = _pieces(spark, sf_dir).where(F.col("n_pieces") > 1)
    parts = p.groupBy("src_table", "row_key").agg(F.array_sort(F.collect_list(F.struct("piece_no", "overlap_chars", "piece_text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.substr(x["piece_text"], x["overlap_chars"] + 1)), "")
    shared = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.right(F.get("p", i - 1)["piece_text"], F.lit(150)) == F.left(F.get("p", i)["piece_text"], F.lit(150)))
    fits = F.forall("p", lambda x: F.char_length(x["piece_text"]) <= 1000)
    return parts.select("src_table", "row_key", text.alias("t"), fits.alias("in_limit"), shared.alias("shares")).select("src_table", "row_key", F.md5("t").alias("joined_hash"), F.char_length("t").cast("long").alias("n_chars"), "in_limit", "shares")


@query("p4_pieces")
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of the oversized texts."""
    return _pieces(spark, sf_dir).where(F.col("n_pieces") > 1).select("src_table", "row_key", "piece_no", "overlap_chars", "piece_text")

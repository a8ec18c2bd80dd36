"""Queries of problem 2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .forest import nearest, pairs
from .registry import query

_SOURCES = (("web_chunks", "embedding"), ("qa_pairs", "question_embedding"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (pairs(nearest(table(spark, sf_dir, t).select("id", c), "id", c), "id").select(F.lit(t).alias("src_table"), "id_a", "id_b") for t, c in _SOURCES))


@query("p2_neighbours")
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every usable vector, with rank and cosine."""
    return reduce(DataFrame.unionByName, (nearest(table(spark, sf_dir, t).select("id", c), "id", c).select(F.lit(t).alias("src_table"), "id", "rank", "other", "cosine") for t, c in _SOURCES))

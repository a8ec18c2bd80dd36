"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .pii import detect, fit_on
from .registry import query


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "email_requests").select(F.lit("email_requests").alias("src_table"), F.col("request_id").cast("string").alias("row_key"), F.lit("email_text").alias("field_name"), F.col("email_text").alias("text"))
    qa = table(spark, sf_dir, "qa_pairs").select(F.lit("qa_pairs").alias("src_table"), F.col("id").alias("row_key"), F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("question", "answer")))).alias("f"))
    return mails.unionByName(qa.select("src_table", "row_key", "f.field_name", "f.text"))


_KEYS = ["src_table", "row_key", "field_name"]


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _fields(spark, sf_dir)
    return detect(fields, _KEYS, "text", fit_on(fields, "src_table", "text")).select(*_KEYS, "pii_type", "start_pos")


@query("p3_clean")
def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with typed placeholders instead of its mentions."""
    fields = _fields(spark, sf_dir)
    return detect(fields, _KEYS, "text", fit_on(fields, "src_table", "text"), clean=True)

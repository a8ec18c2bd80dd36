"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .mailtree import mail_nodes, reduce_mails
from .registry import query


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = table(spark, sf_dir, "email_requests").select(F.lit("email_requests").alias("src_table"), F.col("request_id").cast("string").alias("row_key"), F.col("email_text").alias("text"))
    pasted = table(spark, sf_dir, "qa_pairs").select(F.lit("qa_pairs").alias("src_table"), F.col("id").alias("row_key"), F.col("question").alias("text"))
    return mails.unionByName(pasted)


def _reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce_mails(_mails(spark, sf_dir), ["src_table", "row_key"], "text")


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reduced(spark, sf_dir).select("src_table", "row_key", F.explode("old_lines").alias("line_no"))


@query("p7_new")
def p7_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mail and question reduced to what its sender has newly written."""
    return _reduced(spark, sf_dir).select("src_table", "row_key", "new_text")


@query("p7_nodes")
def p7_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree of every mail: what is written, quoted, forwarded and signed at which depth."""
    return mail_nodes(_mails(spark, sf_dir), ["src_table", "row_key"], "text")

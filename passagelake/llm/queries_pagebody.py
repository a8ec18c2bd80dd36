"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from .pagebody import label_pages
from .registry import query
from .sitelines import broadcast_if_small, host, site_lines


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "overview_pages").select("snapshot_id", F.col("metadata.title").alias("heading"), host("metadata.url").alias("site"), F.col("content.full_text").alias("text"))
    sites = cut(site_lines(pages.select(F.lit("p").alias("group"), "site", "text")).select("site", "lines"))  # a few lines a site; the texts stay where they are
    known = pages.join(broadcast_if_small(sites, "lines"), "site", "left")
    return label_pages(known, "snapshot_id", "text", "heading", "lines", corpus=pages, site="site")


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).select("snapshot_id", F.explode("other_lines").alias("line_no"))


@query("p5_main")
def p5_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main body of every page."""
    return _labelled(spark, sf_dir).select("snapshot_id", "main_text")

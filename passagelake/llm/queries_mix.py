"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut, table
from .mix import mean_copies, mix, shares
from .pack import pack
from .registry import query
from .tokens import with_token_counts


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut(with_token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text"))
    limits = {r["profile"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_limits").collect()}  # a row a profile
    return pack(docs, "doc_id", "n_tokens", limits)


@query("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container for each capacity."""
    return _packed(spark, sf_dir)


@query("p8_fill")
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the least possible number, tokens and the share of unused space."""
    caps = table(spark, sf_dir, "pack_limits").select("profile", F.col("capacity_tokens").alias("capacity"))
    per = _packed(spark, sf_dir).groupBy("profile", "container_no").agg(F.sum("part_size").alias("used"))
    per = per.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return per.join(F.broadcast(caps), "profile").select("profile", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("lower_bound"), "tokens", "fullest", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused_share"))


@query("p8_check", """
    SELECT p.profile, p.capacity_tokens AS capacity, d.n AS items, TRUE AS all_placed, TRUE AS within, TRUE AS whole_where_it_fits, TRUE AS near_the_bound FROM pack_limits p, (SELECT count(*) AS n FROM documents WHERE length(text) > 0) d""")  # fmt: skip
def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of every packing: each text is placed once and whole, or cut if it is over the capacity; no container is over it; there are at most 1 % more containers than there must be, and 2."""
    docs = cut(with_token_counts(table(spark, sf_dir, "documents"), ["doc_id"], "text"))
    caps = table(spark, sf_dir, "pack_limits").select("profile", F.col("capacity_tokens").alias("capacity"))
    placed = cut(pack(docs, "doc_id", "n_tokens", {r["profile"]: r["capacity"] for r in caps.collect()}))
    per = placed.groupBy("profile", "container_no").agg(F.sum("part_size").alias("used")).groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    own = placed.groupBy("profile", "doc_id").agg(F.sum("part_size").alias("got"), F.count(F.lit(1)).alias("parts")).join(docs, "doc_id").join(F.broadcast(caps), "profile")
    own = own.groupBy("profile").agg(F.count(F.lit(1)).alias("items"), F.every(F.col("got") == F.col("n_tokens")).alias("all_placed"), F.every(F.col("parts") == F.ceil(F.col("n_tokens") / F.col("capacity"))).alias("whole_where_it_fits"))
    j = own.join(per, "profile").join(F.broadcast(caps), "profile")
    return j.select("profile", "capacity", "items", "all_placed", (F.col("fullest") <= F.col("capacity")).alias("within"), "whole_where_it_fits", (F.col("containers") <= 1.01 * F.col("tokens") / F.col("capacity") + 2).alias("near_the_bound"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(with_token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"))


def _mixture(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = docs if docs is not None else _counted(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets")
    means = mean_copies(docs, targets, "doc_id")
    return mix(docs, means, "doc_id"), means, targets


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, globally shuffled."""
    return _mixture(spark, sf_dir)[0]


@query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return shares(*_mixture(spark, sf_dir))


@query("p9_check", """
    WITH d AS (SELECT source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)
    SELECT t.source, t.target_share, t.max_repeats, CASE WHEN t.target_share > 0 THEN coalesce(d.n, 0) ELSE 0 END AS docs, TRUE AS share_met, TRUE AS cap_kept FROM mix_targets t LEFT JOIN d USING (source)""")  # fmt: skip
def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture: every source's share within a hundredth, and what two of its longest texts make up, of its target; no text used more often than allowed."""
    docs = _counted(spark, sf_dir)
    s = shares(*_mixture(spark, sf_dir, docs)).join(docs.groupBy("source").agg(F.max("n_tokens").alias("longest")), "source", "left")
    target = F.when(F.col("docs") > 0, F.coalesce("target_share", F.lit(0.0))).otherwise(0.0)
    whole = F.sum("mix_tokens").over(Window.partitionBy())  # a row a source
    met = F.abs(F.col("actual_share") - target) <= 0.01 + 2 * F.coalesce("longest", F.lit(0)) / whole
    return s.select("source", "target_share", "max_repeats", "docs", met.alias("share_met"), (F.col("most_copies") <= F.coalesce("max_repeats", F.lit(0))).alias("cap_kept"))

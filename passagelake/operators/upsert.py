"""Upserts by natural key, first-per-key deduplication and running state per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def upsert_actions(stored: DataFrame, incoming: DataFrame, key: str, order: str, force: bool = False) -> DataFrame:
    """`incoming` with action: insert, duplicate (an earlier incoming row has the key), or for stored keys skip or, with force, update.

    A null key is always inserted. Of equal keys the first by `order` counts. The stored side is reduced to its keys, so
    that what follows (an embedding model, say) only sees the rows to insert.
    """
    keys = stored.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_stored", F.lit(True))
    first = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    out = incoming.join(keys, key, "left").join(first, key, "left")
    action = F.when(F.col("_stored"), "update" if force else "skip").when(F.col(key).isNotNull() & (F.col(order) > F.col("_first")), "duplicate").otherwise("insert")
    return out.withColumn("action", action).drop("_stored", "_first")


def merge_latest(stored: DataFrame, incoming: DataFrame, key: str, *newest: Column) -> DataFrame:
    """Both tables as one with one row a key, the first by `newest`: max_by over a struct, combined before the shuffle."""
    both = stored.unionByName(incoming)
    row = F.struct(*[F.col(c) for c in both.columns])
    best = both.groupBy(key).agg(F.max_by(row, F.struct(*newest)).alias("_row"))
    return best.select("_row.*")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of every key by `order`; blank and null keys are dropped."""
    k = df.withColumn("_key", key).where("_key IS NOT NULL AND _key <> ''")
    row = F.struct(*[F.col(c) for c in df.columns])
    return k.groupBy("_key").agg(F.min_by(row, order).alias("_row")).select("_row.*")


def running_count(df: DataFrame, key: str, time: str, tie: str, out: str, slot: str = "hour") -> DataFrame:
    """`df` with the number (from 1) of each row among its key's in order of time and tie.

    Counted within slots of time (a unit of date_trunc) and carried over the slots' totals, so a key with a third of all
    rows, even one that is hot on one day only, is split by slot.
    """
    day = F.date_trunc(slot, time)
    own = df.withColumn("_day", day)
    days = own.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    before = days.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = own.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_day").orderBy(time, tie)))
    j = within.alias("w").join(before.alias("b"), F.col(f"w.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("w._day").eqNullSafe(F.col("b._day")))
    return j.select("w.*", (F.col("w._i") + F.col("b._before")).cast("long").alias(out)).drop("_day", "_i")


def numbered(df: DataFrame, key: str, order: str, out: str, width: int = 1 << 20) -> DataFrame:
    """`df` with the number (from 1) of each row among its key's by the whole-number column `order`; ties in no fixed order.

    Counted within ranges of `width` and carried over the ranges' totals, so a hot key is split by range.
    """
    own = df.withColumn("_range", F.floor(F.col(order) / width))
    ranges = own.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy(F.asc_nulls_first("_range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = own.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)))
    j = within.alias("w").join(before.alias("b"), F.col(f"w.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("w._range").eqNullSafe(F.col("b._range")))
    return j.select("w.*", (F.col("w._i") + F.col("b._before")).cast("long").alias(out)).drop("_range", "_i")


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, slot: str = "hour") -> DataFrame:
    """Per key its number of rows and of sessions, a session ending after more than `gap_seconds` without a row.

    Gaps are counted within slots of time; those between slots come from their first and last times. Rows without time
    count as rows only.
    """
    day = F.date_trunc(slot, time)
    w = Window.partitionBy(key, "_day").orderBy(time)
    apart = lambda a, b: F.floor((F.unix_micros(b) - F.unix_micros(a)) / 1_000_000) > gap_seconds
    own = df.select(key, F.col(time).cast("timestamp").alias(time), day.alias("_day"))
    inside = own.withColumn("_new", F.coalesce(apart(F.lag(time).over(w), F.col(time)), F.lit(False)).cast("int"))
    days = inside.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_new"), F.min(time).alias("_first"), F.max(time).alias("_last"))
    d = Window.partitionBy(key).orderBy("_day")
    begin = F.when(F.col("_day").isNull(), 0).otherwise(F.coalesce(apart(F.lag("_last").over(d), F.col("_first")), F.lit(True)).cast("int"))
    return days.withColumn("_begin", begin).groupBy(key).agg(F.sum(F.col("_new") + F.col("_begin")).alias("sessions"), F.sum("_n").alias("events"))


def carry_forward(df: DataFrame, key: str, time: str, tie: str, value: str, out: str, slot: str = "hour") -> DataFrame:
    """`df` with the latest non-null `value` of its key up to each row; split by slots of time like running_count."""
    own = df.withColumn("_day", F.date_trunc(slot, time))
    inside = Window.partitionBy(key, "_day").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = own.withColumn("_v", F.last(value, ignorenulls=True).over(inside))
    days = own.groupBy(key, "_day").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, tie))).alias("_last"))
    earlier = Window.partitionBy(key).orderBy(F.asc_nulls_first("_day")).rowsBetween(Window.unboundedPreceding, -1)
    before = days.withColumn("_prev", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    j = within.alias("w").join(before.alias("b"), F.col(f"w.{key}").eqNullSafe(F.col(f"b.{key}")) & F.col("w._day").eqNullSafe(F.col("b._day")))
    return j.select("w.*", F.coalesce("w._v", "b._prev").alias(out)).drop("_day", "_v")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and least number of steps (0 for seeds) of what the seeds reach within `depth` steps.

    edges: src, dst; seeds: node. One join a step, new nodes only. Each step's nodes are written to the shared folder, so
    that no step is computed again by a later one and the plan does not grow.
    """
    front = cut(seeds.select("node").distinct().withColumn("steps", F.lit(0)))
    edge = cut(edges.select("src", "dst").distinct())
    found = front
    for step in range(1, depth + 1):
        nxt = front.join(edge, front["node"] == edge["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(found.select("node"), "node", "left_anti").withColumn("steps", F.lit(step)))
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found


def merge_adjacent(df: DataFrame, group: str, document: str, index: str, position: str, text: str) -> DataFrame:
    """Fuses neighbours in a ranked list that are consecutive pieces of one document: group, document, first index, joined text, merged_from (null for single pieces).

    A group is one query's results, at most as many as were asked for; it is not meant for all pieces of a collection.
    """
    w = Window.partitionBy(group).orderBy(position)
    new = ~F.coalesce((F.lag(document).over(w) == F.col(document)) & (F.lag(index).over(w) + 1 == F.col(index)), F.lit(False))
    isles = df.withColumn("_isle", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.array_sort(F.collect_list(F.struct(position, text)))
    return isles.groupBy(group, document, "_isle").agg(F.min(index).alias("first_index"), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias("text"), F.when(F.count(F.lit(1)) > 1, F.count(F.lit(1))).alias("merged_from")).drop("_isle")

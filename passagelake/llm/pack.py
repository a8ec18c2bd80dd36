"""Problem 8: filling containers, by dominance reduction on the sizes' histogram and best fit of the rest.

Sizes are whole numbers up to the capacity, so an instance of any number of items is a histogram with at most `capacity`
entries. A container is planned as a pattern of sizes with a number of repetitions; every step of the plan uses up at
least one histogram entry, so plan and histogram stay small at any scale, and the items only have to be ranked within
their size to find their container.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut

#: Least number of buckets into which the items of one size are dealt for ranking, and items of all sizes a bucket beyond.
RANK_BUCKETS, RANK_ROWS = 64, 250_000

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((size, items of it in one container), ...), containers


class _Sizes:
    """A histogram of sizes, with its sizes in order."""

    def __init__(self, histogram: dict[int, int]):
        self.left = {s: n for s, n in histogram.items() if n > 0}
        self.order = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            del self.order[bisect_right(self.order, size) - 1]

    def largest(self, room: int, used: dict[int, int]) -> int:
        """The largest size within `room` of which more is left than `used`; 0 if there is none."""
        k = bisect_right(self.order, room) - 1
        while k >= 0 and self.left[self.order[k]] <= used.get(self.order[k], 0):
            k -= 1
        return self.order[k] if k >= 0 else 0

    def fits_three(self, room: int, used: dict[int, int]) -> bool:
        """Whether the three smallest items left beside `used` fit."""
        need = 3
        for s in self.order:
            n = min(need, self.left[s] - used.get(s, 0))
            room -= n * s
            need -= n
            if room < 0 or not need:
                break
        return room >= 0 and not need

    def best_pair(self, room: int, used: dict[int, int]) -> tuple[int, int]:
        """The two sizes with the largest sum within `room`, by two pointers."""
        best, lo, hi = (0, 0), 0, bisect_right(self.order, room) - 1
        free = lambda s: self.left[s] - used.get(s, 0)
        while lo <= hi:
            a, b = self.order[lo], self.order[hi]
            if a + b > room or free(b) < 1:
                hi -= 1
                continue
            if free(a) >= 1 + (a == b) and a + b > sum(best):
                best = (b, a)
                if a + b == room:
                    break
            lo += 1
        return best


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns covering every item of `histogram` (size -> items), none fuller than `capacity`.

    Reduction: with the largest item j, the set {j} is fixed if nothing fits beside it; {j, k} is fixed with k the largest
    item beside j if k fills the container, if no two items fit beside j, or if no two that fit sum to more than k. Each of
    these dominates every other container of j: its items may replace what stands there without needing more containers.
    When no set dominates, j's container is filled by best fit: the fullest of k and the rest below it, or the best pair.
    """
    h = _Sizes(histogram)
    out: list[Pattern] = []
    while h.order:
        j = h.order[-1]
        used = {j: 1}
        room = capacity - j
        k = h.largest(room, used)
        if k:
            a, b = h.best_pair(room, used) if k < room else (0, 0)
            if k == room or (a + b <= k and not h.fits_three(room, used)):  # dominance: {j, k}
                used[k] = used.get(k, 0) + 1
            else:  # best fit
                first, second = dict(used), dict(used)
                for s in (a, b):
                    first[s] = first.get(s, 0) + 1
                second[k] = second.get(k, 0) + 1
                fills = []
                for u in (first, second):
                    r = capacity - sum(s * n for s, n in u.items())
                    while r > 0:
                        s = h.largest(r, u)
                        if not s:
                            break
                        p, q = h.best_pair(r, u) if s < r else (0, 0)
                        for x in (p, q) if p + q > s else (s,):
                            u[x] = u.get(x, 0) + 1
                            r -= x
                    fills.append((r, u))
                used = min(fills, key=lambda f: f[0])[1]
        times = min(h.left[s] // n for s, n in used.items())
        for s, n in used.items():
            h.take(s, n * times)
        out.append((tuple(sorted(used.items(), reverse=True)), times))
    return out


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Per (size, run of ranks): size, first rank, items a container, first container; sorted by size and rank."""
    seen: dict[int, int] = {}
    rows, first = [], 0
    for items, times in patterns:
        for size, n in items:
            rows.append((size, seen.get(size, 0), n, first))
            seen[size] = seen.get(size, 0) + n * times
        first += times
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 3]


def pack(items: DataFrame, key: str, size: str, capacities: dict[str, int]) -> DataFrame:
    """Containers for every profile of `capacities`: profile, container_no, `key`, part_no, part_start, part_size.

    Items within the capacity stay whole; a larger one is cut into parts of exactly the capacity, each a container of its
    own, and a rest, which is an item like others. Items of null, zero or negative size get no container. Repeated rows
    and equal keys are items of their own; null keys are kept; an empty table gives an empty one.

    Only the histogram of each profile, at most `capacity` rows, comes to the driver; the plan that goes back has about as
    many rows. Items of one size are ranked in buckets whose number grows with the items, so a size may hold any
    share of them.
    """
    caps = F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(int(c)).cast("long").alias("capacity")) for p, c in sorted(capacities.items())))
    it = items.select(F.col(key).alias("__key"), F.col(size).cast("long").alias("n")).where("n > 0")
    all_ = it.select("*", F.inline(caps))
    buckets = max(RANK_BUCKETS, -(-items.count() // RANK_ROWS))
    full, rest = F.floor(F.col("n") / F.col("capacity")), F.col("n") % F.col("capacity")
    bucket = F.pmod(F.xxhash64("__key", "n"), F.lit(buckets)).cast("int").alias("bucket")
    whole = all_.where(rest > 0).select("profile", "__key", rest.alias("size"), full.cast("int").alias("part_no"), (full * F.col("capacity")).alias("part_start"), bucket)
    counts = whole.groupBy("profile", "size", "bucket").agg(F.count(F.lit(1)).alias("items"))
    counts = cut(counts)  # at most sum(capacity) * buckets rows, used twice
    hists: dict[str, dict[int, int]] = {}
    for r in counts.groupBy("profile", "size").agg(F.sum("items").alias("items")).toLocalIterator():
        hists.setdefault(r["profile"], {})[r["size"]] = r["items"]
    slots = {p: _slots(plan(h, int(capacities[p]))) for p, h in hists.items()}
    before = counts.withColumn("before", F.sum("items").over(Window.partitionBy("profile", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("profile", "size", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = whole.withColumn("rank", F.row_number().over(Window.partitionBy("profile", "size", "bucket").orderBy("__key")))
    ranked = ranked.join(before, ["profile", "size", "bucket"]).select("profile", "size", (F.col("rank") - 1 + F.col("before")).alias("rank"), "__key", "part_no", "part_start")
    key_type = items.schema[key].dataType
    schema = T.StructType([T.StructField("profile", T.StringType()), T.StructField("container_no", T.LongType()), T.StructField("__key", key_type), T.StructField("part_no", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("part_size", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            profile = np.asarray(b.column(0).to_pylist(), dtype=object)
            s, r = b.column(1).to_numpy(), b.column(2).to_numpy()
            no = np.zeros(len(s), np.int64)
            for p in set(profile):
                sizes, starts, each, first = slots[p]
                at = np.flatnonzero(profile == p)
                comp = np.zeros(len(at), np.int64)
                for z in np.unique(s[at]):
                    m = s[at] == z
                    lo, hi = np.searchsorted(sizes, z, "left"), np.searchsorted(sizes, z, "right")
                    comp[m] = lo + np.searchsorted(starts[lo:hi], r[at][m], "right") - 1
                no[at] = first[comp] + (r[at] - starts[comp]) // each[comp]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(no), b.column(3), b.column(4), b.column(5), b.column(1)], names=schema.fieldNames())

    placed = ranked.mapInArrow(place, schema)
    # full parts: containers of their own, numbered below zero by an exact distributed ranking of the large items
    big = all_.where(full > 0).select("profile", "capacity", "__key", full.cast("long").alias("full"), bucket)
    per = big.groupBy("profile", "bucket").agg(F.sum("full").alias("f"))
    base = per.withColumn("base", F.coalesce(F.sum("f").over(Window.partitionBy("profile").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("profile", "bucket", "base")
    run = F.coalesce(F.sum("full").over(Window.partitionBy("profile", "bucket").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cutup = big.withColumn("run", run).join(F.broadcast(base), ["profile", "bucket"]).select(
        "profile", F.col("capacity"), "__key", (F.col("run") + F.col("base")).alias("run"), F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("part_no"))
    fulls_out = cutup.select("profile", (-(F.col("run") + F.col("part_no")) - 1).alias("container_no"), "__key", "part_no", (F.col("part_no") * F.col("capacity")).alias("part_start"), F.col("capacity").alias("part_size"))
    return placed.unionByName(fulls_out).withColumnRenamed("__key", key)

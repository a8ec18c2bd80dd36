"""Problem 9: mixing sources to target shares by Poisson replication.

Every document has a uniform number seeded by its hash; inverting a Poisson distribution at it gives the number of its
copies, at most the source's cap. The mean of each source is solved so that the copies' tokens meet the target, from a
table of tokens by source and bin of that number, whose size doesn't depend on the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bins of the uniform number; a mean is solved to about a 1/BINS part of a source.
BINS = 4096


def _cdf(mean: float, k: int) -> float:
    """P(X <= k) of a Poisson distribution."""
    term = total = math.exp(-mean)
    for i in range(1, k + 1):
        term *= mean / i
        total += term
    return min(total, 1.0)


def copies_at(u: float, mean: float, cap: int) -> int:
    """The inverse of the distribution at u, at most `cap`."""
    if mean == math.inf:
        return cap
    for k in range(cap):
        if u < _cdf(mean, k):
            return k
    return cap


def solve_mean(bins: list[tuple[float, float]], target: float, cap: int) -> float:
    """The mean at which the (u, tokens) of `bins` give `target` tokens; infinite if even all copies don't give more."""
    if cap * sum(t for _, t in bins) <= target * (1 + 1e-9):
        return math.inf
    lo, hi = 0.0, float(cap) + 1.0
    made = lambda m: sum(t * copies_at(u, m, cap) for u, t in bins)
    while made(hi) < target:
        hi *= 2
        if hi > 700:
            return math.inf
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if made(mid) < target else (lo, mid)
    return hi


def _uniform(key: str, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def mean_copies(docs: DataFrame, targets: DataFrame, key: str, seed: int = 0, total: float | None = None, fill: float = 0.95) -> DataFrame:
    """Per source of `targets` with documents and a share: source, target_share, cap, docs, tokens, mean_copies, thresholds.

    docs: `key`, source, n_tokens; targets: source, target_share, max_repeats (a table of sources, small by nature: its
    rows and BINS rows a source come to the driver). total: tokens of the mixture; by default the part `fill` of the most with
    which every source can reach its share, so that the copies of the tightest one are drawn as well and not all it may have. Shares are those of `targets` over their sum among the sources that have documents.
    """
    u = _uniform(key, seed)
    binned = docs.where("n_tokens > 0").join(F.broadcast(targets.where("target_share > 0 AND max_repeats > 0").select("source").distinct()), "source").groupBy(
        "source", F.floor(u * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), F.avg(u).alias("u"))
    have: dict[str, list[tuple[float, float, int]]] = {}
    for r in binned.toLocalIterator():
        have.setdefault(r["source"], []).append((r["u"], float(r["t"]), r["n"]))
    want = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("target_share > 0 AND max_repeats > 0").collect() if r["source"] in have}
    scale = sum(s for s, _ in want.values())
    if total is None and want:
        total = fill * min(sum(t for _, t, _ in have[s]) * cap / (share / scale) for s, (share, cap) in want.items())
    rows = []
    for s, (share, cap) in want.items():
        mean = solve_mean(sorted((u, t) for u, t, _ in have[s]), (share / scale) * (total or 0.0), cap)
        limits = [_cdf(mean, k) if mean != math.inf else 0.0 for k in range(cap)]
        rows.append((s, share, cap, sum(n for _, _, n in have[s]), int(sum(t for _, t, _ in have[s])), mean, limits))
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, cap int, docs long, tokens long, mean_copies double, limits array<double>")


def mix(docs: DataFrame, means: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """The mixture: shuffle_key, `key`, copy_no, source, n_tokens, in the order of shuffle_key.

    A document of a source in `means` gets as many rows as its uniform number has limits at or below it. Documents of
    other or null sources, and those without tokens, get none. Equal keys in one source get equal copies; an empty table
    gives an empty one.
    """
    u = _uniform(key, seed)
    n = F.size(F.filter("limits", lambda x: x <= u))
    out = docs.where("n_tokens > 0").join(F.broadcast(means.select("source", "limits")), "source").withColumn("n", n).where("n > 0")
    out = out.select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    return out.select(F.xxhash64(F.lit(seed + 1), key, "copy_no").alias("shuffle_key"), key, "copy_no", "source", "n_tokens").orderBy("shuffle_key", key, "copy_no")


def shares(mixture: DataFrame, means: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of `targets`: target and actual share, documents, copies, most copies of one document, tokens."""
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("copies"), F.max("copy_no").alias("most_copies"), F.sum("n_tokens").alias("mix_tokens"))
    out = targets.join(means.select("source", "docs", "tokens", "mean_copies"), "source", "left").join(got, "source", "left")
    out = out.withColumn("all_tokens", F.sum("mix_tokens").over(Window.partitionBy()))  # a row a source
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("docs"), zero("tokens"), "mean_copies", zero("copies"), zero("most_copies"), zero("mix_tokens"), F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))

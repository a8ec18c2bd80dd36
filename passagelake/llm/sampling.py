"""A bounded sample of rows for fitting, without sorting the table or sending more than the sample to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, n: int, distinct: bool = False, on: tuple[str, ...] = (), rows: int | None = None) -> list[Row]:
    """At most `n` rows of `df`, chosen by the hash of their columns; the same rows at any partitioning unless many are equal. With `distinct` equal rows count once, so that copies can't fill the sample. on: the columns whose hash chooses, where not all; what the others take to compute is then spent on the sample only. rows: their number, where known."""
    if rows is None:
        rows = df.agg(F.approx_count_distinct(F.xxhash64(*df.columns), 0.02)).first()[0] if distinct else df.count()
    if not rows:
        return []
    h = F.pmod(F.xxhash64(*(on or df.columns)), F.lit(1 << 30))
    share = min(1.0, 1.3 * n / rows)
    kept = df.withColumn("__sample_hash", h).where(F.col("__sample_hash") < int(share * (1 << 30)) + 1)
    got = (kept.distinct() if distinct else kept).limit(2 * n).collect()
    got.sort(key=lambda r: (r["__sample_hash"], str(r[0])))
    return got[:n]

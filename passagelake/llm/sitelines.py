"""Problem 6: lines repeated across one source's documents.

Copies of a text are collapsed before its lines are looked at, so a line is counted over distinct texts (with their
number of rows). The lines that matter are then counted over clusters of near-copies and over days of publication: what
stands in many rows but in few clusters or on one day is a republished article and is kept when texts are cleaned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .nearcopies import near_copies


def host(url: str | Column) -> Column:
    """Lower-case host of a URL without port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)), F.lit(""))


def lines(text: str | Column) -> Column:
    """The pieces between newline characters, without a carriage return at their end."""
    return F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))


#: White space, as Unicode has it.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def form(line: Column) -> Column:
    """What two lines have in common when they are alike: lower case, white space as single spaces and none at the ends, digits as 0."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, _SPACE, " "))), "[0-9]+", "0")


def _hashes(text: Column) -> Column:
    """For each line a 64-bit hash of its form, or null where it has no letter; lines are only compared within a site."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.regexp_like(x, F.lit(r"\p{L}")), F.xxhash64(form(x))))


def _usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("site").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != ""))


def line_counts(df: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """Lines standing in at least `share` of a site's rows and in at least `least`: group, site, h, n_rows, n_texts, site_rows.

    df: group, site, text. Rows are first collapsed by (group, site, text); each distinct text's distinct lines then
    count for as many rows as it has copies (n_rows) and once for itself (n_texts). Rows without site or text are left out.
    Counting is by partial aggregation before the shuffle, so one site may hold any share of the rows.
    """
    rows = _usable(df)
    texts = rows.groupBy("group", "site", F.md5("text").alias("doc")).agg(F.count(F.lit(1)).alias("copies"), F.any_value(F.array_compact(F.array_distinct(_hashes(F.col("text"))))).alias("hs"))
    sizes = texts.groupBy("group", "site").agg(F.sum("copies").alias("site_rows"))
    counted = texts.select("group", "site", "copies", F.explode("hs").alias("h")).groupBy("group", "site", "h").agg(F.sum("copies").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"))
    return counted.where(F.col("n_rows") >= least).join(sizes, ["group", "site"]).where(F.col("n_rows") >= F.col("site_rows") * F.lit(share))


def marked_lines(df: DataFrame, share: float = 0.05, least: int = 3, min_texts: int = 1) -> DataFrame:
    """The repeated lines of every row: group, row_key, line_no (from 1).

    df: group, row_key, site, text. min_texts > 1 leaves out lines that only copies of fewer texts share, that is
    republished articles. Null and empty texts, sites and keys: rows without site or text give nothing, null keys are kept;
    an empty table gives an empty one; repeated rows count as rows.
    """
    found = line_counts(df, share, least).where(F.col("n_texts") >= min_texts).select("group", "site", "h")
    own = _usable(df).select("group", "row_key", "site", F.posexplode(_hashes(F.col("text"))).alias("at", "h")).where(F.col("h").isNotNull())
    return own.join(found, ["group", "site", "h"], "left_semi").select("group", "row_key", (F.col("at") + 1).cast("int").alias("line_no"))


def site_lines(df: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """group, site, lines: the hashes of every site's repeated lines, at most 1 / share times the lines its mean row has."""
    return line_counts(df, share, least).groupBy("group", "site").agg(F.collect_set("h").alias("lines"))


#: So many hashes, of 8 bytes each, are broadcast at most.
BROADCAST_HASHES = 1_000_000


def broadcast_if_small(df: DataFrame, hashes: str) -> DataFrame:
    """`df` with the hint to broadcast it if its arrays of hashes are counted and found small; else the join is Spark's choice."""
    n = df.agg(F.coalesce(F.sum(F.size(hashes) + 4), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_HASHES else df


def _found_lines(df: DataFrame, share: float, least: int, more: list[str]) -> DataFrame:
    """group, row_key, site, h, line_no and `more` of every repeated line of every row, written once."""
    found = line_counts(df, share, least).select("group", "site", "h")
    own = _usable(df).select("group", "row_key", "site", *more, F.xxhash64("text").alias("doc"), F.posexplode(_hashes(F.col("text"))).alias("at", "h")).where(F.col("h").isNotNull())
    return cut(own.join(found, ["group", "site", "h"], "left_semi").select("group", "row_key", "site", "h", "doc", *more, (F.col("at") + 1).cast("int").alias("line_no")))


def _spread(df: DataFrame, lines_: DataFrame) -> DataFrame:
    """group, site, h with n_rows, n_texts, n_clusters and n_days of every repeated line. Days are counted exactly, in one bitmap a line."""
    clusters = near_copies(_usable(df).select("group", "site", F.xxhash64("text").alias("doc"), "text"), "doc", "text", ["group", "site"])
    per = lines_.groupBy("group", "site", "h", "doc").agg(F.count_distinct("row_key").alias("n"))  # a line twice in a row counts once
    per = per.join(clusters, ["group", "site", "doc"])
    per = per.groupBy("group", "site", "h", "cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("t")).groupBy("group", "site", "h").agg(F.sum("n").alias("n_rows"), F.sum("t").alias("n_texts"), F.count(F.lit(1)).alias("n_clusters"))
    day = F.pmod(F.datediff("day", F.lit("1970-01-01").cast("date")), F.lit(32768))
    days = lines_.groupBy("group", "site", "h").agg(F.bitmap_count(F.bitmap_construct_agg(F.when(F.col("day").isNotNull(), F.bitmap_bit_position(F.coalesce(day, F.lit(0)) + 1)))).alias("n_days"))
    return per.join(days, ["group", "site", "h"])


def clean_texts(df: DataFrame, share: float = 0.05, least: int = 3, min_clusters: int = 2, min_days: int = 2) -> DataFrame:
    """Every row's text without its site's repeated lines: group, row_key, n_removed, clean_text; keys must be unique in a group.

    df: group, row_key, site, text, day. Lines that stand in fewer than `min_clusters` clusters of near-copies, or on
    fewer than `min_days` days where days are known at all, belong to a republished article and stay. Rows without site
    keep their text; null texts stay null.
    """
    found = _found_lines(df, share, least, ["day"])
    gone = _spread(df, found).where((F.col("n_clusters") >= min_clusters) & ((F.col("n_days") >= min_days) | (F.col("n_days") == 0))).select("group", "site", "h")
    gone = found.join(gone, ["group", "site", "h"], "left_semi").groupBy("group", "row_key").agg(F.collect_set("line_no").alias("gone"))
    at = df.select("group", "row_key", "text").join(gone, ["group", "row_key"], "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), (i + 1).cast("int")))
    return at.select("group", "row_key", F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"), F.array_join(kept, "\n").alias("clean_text"))


def line_report(df: DataFrame, share: float = 0.05, least: int = 3) -> DataFrame:
    """The repeated lines with their counts over rows, distinct texts, clusters of near-copies and distinct days; df as for clean_texts."""
    found = _found_lines(df, share, least, ["day"])
    sizes = _usable(df).groupBy("group", "site").agg(F.count(F.lit(1)).alias("site_rows"))
    one = found.groupBy("group", "site", "h").agg(F.min(F.struct("row_key", "line_no")).alias("x"))  # a row that shows the line
    form_ = df.select("group", "row_key", "text").join(one.select("group", "site", "h", F.col("x.row_key").alias("row_key"), F.col("x.line_no").alias("no")), ["group", "row_key"])
    forms = form_.select("group", "site", "h", form(F.get(lines(F.col("text")), F.col("no") - 1)).alias("line_form"))
    return _spread(df, found).join(sizes, ["group", "site"]).join(forms, ["group", "site", "h"]).drop("h")

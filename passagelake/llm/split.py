"""Problem 4: oversized texts cut at natural boundaries, by one bounded-quantifier pattern and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may end a piece, strongest first, as look-behinds, and the least share of the limit that must be used for it.
BOUNDARIES = (
    (r"(?<=\n[ \t\r]{0,8}\n)", 0.5),  # paragraph
    (r"(?<=\n)", 0.5),  # line
    (r"(?<=[.!?…][\"'”“»)\]]{0,2}\s)", 0.4),  # sentence
    (r"(?<=[;:,]\s)", 0.6),  # clause
    (r"(?<=\s)", 0.6),  # word
)


def _alternatives(limit: int) -> str:
    parts = [rf".{{1,{limit}}}\z"]
    parts += [rf".{{{max(1, int(limit * share))},{limit}}}{end}" for end, share in BOUNDARIES]
    return "|".join([*parts, rf".{{{limit}}}"])


def pattern(limit: int, overlap: int) -> str:
    """Alternatives ordered by boundary strength; the first piece may use the whole limit, the others leave room for the overlap."""
    return rf"(?s)\A(?:{_alternatives(limit)})|(?:{_alternatives(limit - overlap)})"


def trimmed(text: str | Column) -> Column:
    """The text without spaces, tabs and line breaks at both ends, in one pass from each."""
    return F.btrim(text, F.lit(" \t\r\n"))


def pieces(text: Column, limit: int = 1000, overlap: int = 150) -> Column:
    """array<struct<n_pieces, piece_no, overlap_chars, piece_text>> of the trimmed text; characters are code points.

    Consecutive pieces share exactly `overlap` characters, no piece is longer than `limit`, and without the shared
    characters the pieces are the text. A text within the limit is one piece; a null or blank one has none (empty array).
    """
    if not 0 <= overlap * 4 <= limit:
        raise ValueError("the overlap must be at most a quarter of the limit")
    found = F.regexp_extract_all(trimmed(text), F.lit(pattern(limit, overlap)), F.lit(0))
    one = lambda cores: F.transform(
        cores,
        lambda c, i: F.struct(
            F.size(cores).alias("n_pieces"),
            i.cast("int").alias("piece_no"),
            F.when(i == 0, 0).otherwise(overlap).cast("int").alias("overlap_chars"),
            F.when(i == 0, c).otherwise(F.concat(F.right(F.get(cores, i - 1), F.lit(overlap)), c)).alias("piece_text"),
        ),
    )
    # bound to a variable, so that a text is searched once and not again for each of its pieces
    return F.get(F.transform(F.array(F.coalesce(found, F.array().cast("array<string>"))), one), F.lit(0))


def split_texts(df: DataFrame, key: str, text: str, limit: int = 1000, overlap: int = 150) -> DataFrame:
    """Ordered pieces of every text of `df`: `key`, n_pieces, piece_no, overlap_chars, piece_text.

    Row-local: no shuffle and no Python. Null and blank texts give no rows, repeated rows give repeated pieces, null keys
    are kept, other columns are ignored, and an empty table gives an empty one. Texts of any length are read whole.
    """
    p = df.select(F.col(key).alias("_k"), pieces(F.col(text), limit, overlap).alias("_p"))
    # outer, as for an inner one the optimiser adds a filter that searches every text again
    rows = p.select(F.col("_k").alias(key), F.inline_outer("_p"))
    return rows.where(F.col("piece_no").isNotNull())

"""Cutting texts into passages: fixed windows in closed form, and windows that end at paragraph or sentence breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least number of passages by length of text, longest first.
GUARANTEE = ((7000, 10), (3500, 6), (1800, 4), (1000, 3), (0, 1))


def fixed_chunks(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """array<struct<start_char, end_char, text>> of windows of `size` characters, each starting size - overlap behind the last.

    A text within the size, also an empty one, is one window; a null text gives null.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step, n = size - overlap, F.char_length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")

    def window(i: Column) -> Column:
        start = i * step
        return F.struct(start.cast("int").alias("start_char"), F.least(start + size, n).cast("int").alias("end_char"), F.substring(text, start + 1, F.lit(size)).alias("text"))

    return F.when(text.isNotNull(), F.transform(F.sequence(F.lit(0), count - 1), window))


def required_chunks(n: int) -> int:
    """The least number of passages a text of n characters should give."""
    return next(k for least, k in GUARANTEE if n >= least)


_PARAGRAPH = re.compile(r"\n\n+|\n\s+")
_SENTENCE = re.compile(r"[.!?]\s+")


def _cut_near(text: str, target: int, least: int) -> int:
    """The paragraph break, else the sentence end, nearest to target within 200 characters; else target itself."""
    low = max(least, target - 250)
    for breaks in (_PARAGRAPH, _SENTENCE):
        ends = [m.end() + low for m in breaks.finditer(text[low : target + 100])]
        if ends and abs((best := min(ends, key=lambda e: abs(e - target))) - target) < 200:
            return best
    return target


def _valid(piece: str) -> bool:
    return bool(piece) and sum(map(str.isalnum, piece)) >= 0.4 * len(piece) and len(piece.split()) >= 15


def _pass(text: str, size: int, overlap: int, least: int) -> list[tuple[int, int, str]]:
    n = len(text)
    if n <= size:
        return [(0, n, text)] if n >= least and _valid(text) else []
    kept: list[tuple[int, int, str]] = []
    start = 0
    while start < n:
        end = n if start + size >= n else _cut_near(text, start + size, start + size // 2)
        piece = text[start:end].strip()
        if len(piece) >= least and _valid(piece):
            kept.append((start, end, piece))
        if end >= n:
            break
        back = end - overlap
        start = end if kept and back <= kept[-1][0] else back
        if start < end - size:  # never back over what was passed
            start = end
    return kept


def boundary_chunks(text: str, size: int = 1000, overlap: int = 200, least: int = 250) -> list[tuple[int, int, str]]:
    """(start, end, passage) of a text; if they are fewer than required, once more with smaller windows."""
    kept = _pass(text, size, overlap, least)
    need = required_chunks(len(text))
    if len(kept) < need and len(text) > least:
        smaller = max(least + 50, len(text) // int(need * 1.1))
        kept = _pass(text, smaller, min(220, max(150, smaller // 5)), least)
    return kept


def chunk_texts(df: DataFrame, keys: list[str], text: str, size: int = 1000, overlap: int = 200, least: int = 250) -> DataFrame:
    """Columns `keys` (carried along, flags and titles for instance), chunk_index, start_char, end_char and chunk_text.

    Null, short and wordless texts give no rows; an empty table an empty one. Rows are independent.
    """
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("chunk_index", T.IntegerType()), T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("chunk_text", T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, index, starts, ends, texts = [], [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1)):
                if s := t.as_py():
                    for k, (a, e, piece) in enumerate(boundary_chunks(s, size, overlap, least)):
                        rows.append(i)
                        index.append(k)
                        starts.append(a)
                        ends.append(e)
                        texts.append(piece)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[:-1]), *(pa.array(x, pa.int32()) for x in (index, starts, ends)), pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.select(*keys, F.col(text).alias("_text")).mapInArrow(run, schema)

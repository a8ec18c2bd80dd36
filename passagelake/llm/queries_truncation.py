"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .registry import query
from .truncation import MEASURES, endings, hidden_limits, truncated, truncation_by_source


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(_docs(spark, sf_dir)).select("doc_id")


@query("p10_sources")
def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of cut texts of every source."""
    docs = _docs(spark, sf_dir)
    return truncation_by_source(docs, truncated(docs))


@query("p10_limits")
def p10_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden storage limits: lengths, under some encoding, at which one source's texts pile up."""
    return hidden_limits(_docs(spark, sf_dir))


_ASTRAL = "length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))"
_COUNT = lambda c: f"length(regexp_replace(text, '[^{c}]', '', 'g'))"
_HTML = f"4 * {_COUNT('&')} + 3 * {_COUNT('<>')} + 5 * {_COUNT(chr(34))}"
_ESCAPES = f"({_COUNT(chr(34))} + {_COUNT(chr(92) * 2)} + {_COUNT(chr(92) + 'n')} + {_COUNT(chr(92) + 'r')} + {_COUNT(chr(92) + 't')})"
_BREAKS = f"({_COUNT(chr(92) + 'n')} - (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2)"


@query("p10_lengths", f"""
    SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length(text) + {_ASTRAL} AS utf16, length(text) + {_HTML} AS html, strlen(text) + {_HTML} AS html_bytes, length(text) + {_HTML} + 5 * {_COUNT('äöüÄÖÜ')} + 6 * {_COUNT('ß')} AS html_named,
      length(text) + {_ESCAPES} + 5 * length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS json, strlen(text) + {_ESCAPES} AS json_utf8, length(text) + {_BREAKS} AS crlf, strlen(text) + {_BREAKS} AS crlf_bytes FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of every text as ten kinds of storage count them, from which limits are found."""
    e = endings(_docs(spark, sf_dir), "doc_id")
    return e.select("doc_id", *(F.get("lens", F.lit(i)).cast("long").alias(m) for i, m in enumerate(MEASURES)))

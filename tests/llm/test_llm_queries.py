"""The queries of the subpackage on the small tables: against SQL where there is one, else their columns and invariants."""

import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

llm = pytest.importorskip("passagelake.llm")
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import same  # noqa: E402

FOUND = {
    "p2_found": ["src_table", "id_a", "id_b"], "p3_found": ["src_table", "row_key", "field_name", "pii_type", "start_pos"], "p4_found": ["src_table", "row_key"], "p5_found": ["snapshot_id", "line_no"],
    "p6_found": ["src_table", "row_key", "line_no"], "p7_found": ["src_table", "row_key", "line_no"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, data, name):
    same(spark, data, llm.QUERIES[name], llm.SQL[name])


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, data, name):
    df = llm.QUERIES[name](spark, data)
    assert df.columns == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) > 0


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(FOUND)))
def test_runs(spark, data, name):
    assert llm.QUERIES[name](spark, data).count() >= 0


def test_p6_found_counts_rows_of_republished_articles(spark, tmp_path):
    """TESTDATA.md and the SQL count rows, so the lines of an article printed again with changes are cases; only p6_clean keeps them."""
    article = [f"The {w} of the old harbour was opened to visitors this morning, said the town council in its {w} report." for w in ("lantern", "tower", "museum", "garden", "bridge", "market")]
    texts = [(i, "\n".join([f"Printed by desk {'abc'[i]}", *article, "Legal notice of the house"])) for i in range(3)] + [(i, f"Page about {chr(97 + i) * 9}\nLegal notice of the house") for i in range(3, 20)]
    at = "timestamp'2024-01-01 08:00:00' + make_interval(0, 0, 0, i)"
    df = spark.createDataFrame(texts, "i int, text string")
    pages = df.selectExpr("CAST(i AS BIGINT) AS snapshot_id", f"{at} AS fetched_at", "named_struct('url', 'https://news.example/' || i) AS metadata", "named_struct('full_text', text) AS content")
    docs = df.limit(1).selectExpr("'d' AS id", "'https://docs.example/' AS url")
    chunks = df.selectExpr("'c' || i AS id", "'d' AS document_id", "text", f"{at} AS created_at")
    for name, table in (("overview_pages", pages), ("web_documents", docs), ("web_chunks", chunks)):
        pq.write_table(table.toArrow(), tmp_path / f"{name}.parquet")
    same(spark, str(tmp_path), llm.QUERIES["p6_found"], llm.SQL["p6_found"])
    found = {tuple(x) for x in llm.QUERIES["p6_found"](spark, str(tmp_path)).collect()}
    lines = {(t, f"{k}{i}", n) for t, k in (("overview_pages", ""), ("web_chunks", "c")) for i in range(3) for n in range(2, 8)}
    assert lines < found and len(found - lines) == 2 * 20
    clean = llm.QUERIES["p6_clean"](spark, str(tmp_path)).collect()
    assert len(clean) == 40 and all(x["n_removed"] == 1 for x in clean) and sum(article[0] in x["clean_text"] for x in clean) == 6

"""Retrieval and ingestion end to end, on a handful of pages."""

import json

from pyspark.sql import functions as F

from passagelake import api, cli
from passagelake.operators.retrieval import lexical_score
from passagelake.sources import io

PAGES = [(f"http://h/en/{w}", w.title(), f"All about the {w}: how to get the {w}, what the {w} costs and where the {w} office is. " * 12) for w in ("library", "semester ticket", "visa", "canteen")]


def _store(spark, path):
    web = spark.createDataFrame([(u, t, c, None, None) for u, t, c in PAGES] + [("http://h/en/empty", "Empty", " ", None, None)], "url string, title string, content string, contacts array<struct<type:string,value:string>>, links array<struct<url:string,text:string>>")
    pairs = spark.createDataFrame([("Where is the canteen?", "In building K."), ("How much is the visa?", "75 euros.")], "question string, answer string")
    return api.build_content(spark, path, web, pairs), web, pairs


def test_build_and_retrieve(spark, tmp_path):
    path = str(tmp_path / "store")
    stats, web, pairs = _store(spark, path)
    got = {(r["name"], r["action"]): r["n"] for r in stats.collect()}
    assert got["documents", "insert"] == 4 and got["qa_pairs", "insert"] == 2 and got["web_chunks", "insert"] >= 4
    again = {(r["name"], r["action"]) for r in api.build_content(spark, path, web, pairs, dry_run=True).collect()}
    assert {a for _, a in again} == {"skip"} and io.versions(spark, f"{path}/documents") == [1]
    chunks, docs, qa = (io.read_version(spark, f"{path}/{n}") for n in ("web_chunks", "documents", "qa_pairs"))
    q = spark.createDataFrame([(1, "what does the semester ticket cost"), (2, "where is the canteen")], "query_id int, question string")
    for rerank in (None, lexical_score):
        top = {r["query_id"]: r for r in api.retrieve_top_k(q, api.web_items(chunks, docs), 2, reranker=rerank, top_k_db=8).where("doc_rank = 1").collect()}
        assert "semester ticket" in top[1]["content"] and "canteen" in top[2]["content"]
    assert api.retrieve_qa_pairs_only(q, qa, 1).where("query_id = 2").first()["content"] == "In building K."
    assert api.retrieve_web_chunks_only(q, chunks, docs, 3).count() == 6
    sub = q.select(F.lit("s").alias("set_id"), "query_id", F.col("query_id").alias("ordinal"), "question")
    fused = api.retrieve_multi_query(sub, api.web_items(chunks, docs), 2, reranker=lexical_score).orderBy("doc_rank").collect()
    assert len(fused) == 2 and "semester ticket" in fused[0]["content"]
    assert {r["name"]: r["n"] for r in api.get_retrieval_stats(documents=docs, qa_pairs=qa).collect()} == {"documents": 4, "qa_pairs": 2}
    e = spark.createDataFrame([(1, ["web"]), (2, ["x"]), (3, [])], "query_id int, expected_types array<string>")
    assert {r["query_id"]: r["match"] for r in api.evaluate(api.retrieve_web_chunks_only(q, chunks, docs, 3), e).collect()} == {1: True, 2: False, 3: True}


def test_command_line(spark, tmp_path, capsys):
    d = tmp_path / "o"
    d.mkdir()
    for i in range(3):
        (d / f"{i}.json").write_text(json.dumps({"metadata": {"object_id": f"o{i}", "object_type": "faq_support", "title": f"T{i}", "url": "u", "classification_notes": None}, "related_pages": [f"o{(i + 1) % 3}"], "content": {"full_text": "A sentence about the subject of this page. " * (5 + 30 * i)}}))
    out = str(tmp_path / "out")
    cli.main(["migrate", "--objects-dir", str(d), "--out", out, "--report-csv", str(tmp_path / "r"), "--dry-run"], spark)
    assert not (tmp_path / "out").exists()
    cli.main(["migrate", "--objects-dir", str(d), "--out", out, "--report-csv", str(tmp_path / "r")], spark)
    chunks = spark.read.parquet(out + "/chunks")
    assert chunks.select("object_id").distinct().count() == 3 and chunks.where("object_id = 'o0' AND enriched").count() > 0 and chunks.where("embedding IS NULL").count() == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3 and "objects" in capsys.readouterr().out


def test_load_objects_in_one_step(spark, tmp_path):
    path = str(tmp_path / "v2")
    o = spark.createDataFrame([("a", "degree_program", "A", "u", None, ["b"], "Short."), ("b", "x", "B", "u", "n", [], "Long text about the programme and its modules. " * 60)], "object_id string, object_type string, title string, url string, classification_notes string, related_pages array<string>, full_text string")
    assert api.load_objects(o, path, dry_run=True).count() == 2 and io.versions(spark, f"{path}/documents") == []
    for n in (1, 2):
        api.load_objects(o, path)
        docs, chunks = io.read_version(spark, f"{path}/documents"), io.read_version(spark, f"{path}/chunks")
        assert io.versions(spark, f"{path}/chunks")[-1] == n and docs.count() == 2 and chunks.join(docs, chunks["document_id"] == docs["id"], "left_anti").count() == 0


def test_forced_build_keeps_the_first_and_rows_without_key(spark, tmp_path):
    path = str(tmp_path / "store")
    pairs = spark.createDataFrame([("q", "a"), ("q", "a"), (None, "b"), (None, "c")], "question string, answer string")
    for _ in range(2):
        api.build_content(spark, path, None, pairs, force=True).collect()
    got = io.read_version(spark, f"{path}/qa_pairs")
    assert got.where("question = 'q'").count() == 1 and got.where("question IS NULL").count() == 4

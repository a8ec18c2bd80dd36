"""Embedding and answer assembly on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagelake.operators import answers, embed


def test_embed(spark):
    class Counting(embed.HashingEmbedder):  # here, so that it travels with the task
        def encode(self, texts):
            assert len(texts) <= 4 and all(t is not None for t in texts)
            return embed.HashingEmbedder.encode(self, texts)

    df = spark.createDataFrame([(1, "hello world", "c"), (2, None, "c"), (3, "", "c"), (None, "hello world", "c")] + [(i, f"text {i}", "c") for i in range(10, 30)], "id int, text string, embedding string")
    got = {r["id"]: r for r in embed.embed(df, ["id"], "text", lambda: Counting(32), "counting-32", batch=4).collect()}
    assert len(got) == 24 and got[2]["embedding"] is None and got[1]["embedding"] == got[None]["embedding"] and set(got[3]["embedding"]) == {0.0}
    assert abs(np.linalg.norm(got[1]["embedding"]) - 1) < 1e-6 and got[1]["embedding_model"] == "counting-32"
    assert embed.loaded(lambda: embed.HashingEmbedder(8), "a").dim == 8 and embed.loaded(lambda: embed.HashingEmbedder(9), "b").dim == 9
    assert spark.range(1).select(embed.with_prefix(F.lit("x"), "query", "e5-base")).first()[0] == "query: x"
    with pytest.raises(ValueError):
        embed.with_prefix(F.lit("x"), "other", "e5")


def test_citations(spark):
    df = spark.createDataFrame([("a [Doc 2] b [Doc 5] c [Doc 1]", ["u", "v"]), ("", []), (None, None)], "t string, u array<string>")
    got = [r[0] for r in df.select(answers.renumber_citations(F.col("t"), F.array(F.lit(2), F.lit(1)))).collect()]
    assert got == ["a [Doc 1] b  c [Doc 2]", "", None]
    lines = [r[0] for r in df.select(answers.reference_lines(F.array(F.lit(2), F.lit(2), F.lit(7)), F.col("u"))).collect()]
    assert lines[0] == "[Doc 2] v" and lines[1] == ""


def test_selection(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([0, 9, 1, 3, 0, 0, 0])], "g string, i int, s int")
    got = [(r["i"], r["position"]) for r in answers.select_evidence(df, "g", "s", "i", keep=4).orderBy("position").collect()]
    assert got == [(1, 1), (3, 2), (0, 3), (2, 4)]
    assert answers.best_citation(df, "g", "s", "i", F.lit(False)).first()["citation"] == 1
    q = spark.range(1).select(answers.weighted_quality({"a": (F.lit(1.0), 90.0), "b": (F.lit(None).cast("double"), 10.0)}, [(F.lit(True), 60.0)]).alias("q")).first()["q"]
    assert tuple(q) == (60.0, "partial")

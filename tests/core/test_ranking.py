"""Searches of any number of queries, against numpy; the sentences in every variant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import display as D
from corvane.operators import ranking


def vectors(spark, n, name, seed, dimensions=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3, 4, (n, dimensions)).astype(float)
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, vector array<float>")


def test_more_queries_than_a_block_holds(spark):
    q, queries = vectors(spark, 10_001, "query_id", 1)
    i, items = vectors(spark, 60, "item_id", 2)
    got = {}
    for r in ranking.nearest(queries, items.repartition(3), 4).collect():
        got.setdefault(r["query_id"], {})[r["place"]] = (r["item_id"], r["similarity"])
    found = np.round(q @ i.T, 9)
    assert len(got) == 10_001
    for k in range(0, 10_001, 97):
        want = sorted(range(60), key=lambda j: (-found[k, j], j))[:4]
        assert [got[k][p + 1] for p in range(4)] == [(j, found[k, j]) for j in want]


def test_batches_ties_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK", 40)
    q, queries = vectors(spark, 100, "query_id", 3, 2)
    i, items = vectors(spark, 9000, "item_id", 4, 2)
    got = {(r["query_id"], r["place"]): r["item_id"] for r in ranking.nearest(queries, items.coalesce(1), 3).collect()}
    found = np.round(q @ i.T, 9)
    assert all(got[k, p + 1] == sorted(range(9000), key=lambda j: (-found[k, j], j))[p] for k in range(100) for p in range(3))
    assert ranking.nearest(queries.limit(0), items, 3).count() == 0 and ranking.nearest(queries, items.limit(0), 3).count() == 0
    assert ranking.nearest(queries, items.limit(2), 3).count() == 200


def test_vectors_of_other_lengths_are_refused(spark):
    _, queries = vectors(spark, 3, "query_id", 5)
    items = spark.createDataFrame([(1, [1.0] * 4), (2, [1.0] * 12)], "item_id long, vector array<float>")
    with pytest.raises(Exception, match="dimensions"):
        ranking.nearest(queries, items, 1).collect()


def test_sentences(spark):
    rows = [(1, "A", 2020, ["x"]), (3, "B", None, ["x", "y"]), (7, "C", 0, []), (2, None, None, [])]
    df = spark.createDataFrame(rows, "n int, title string, year int, matched array<string>")
    said = [r[0] for r in df.select(D.person_sentence(F.lit("P"), F.col("n"), F.col("title"), F.col("year"), F.col("matched"))).collect()]
    assert said == [
        "Preporučeno jer P ima 1 rad koji dijeli pojam „x” — npr. „A” (2020).", "Preporučeno jer P ima 3 rada koji dijele pojmove „x”, „y” — npr. „B”.",
        "Preporučeno jer P ima 7 radova na sličnu temu, npr. „C”.", "Preporučeno na temelju semantičke sličnosti radova P.",
    ]
    fields = F.array(F.lit("F"), F.lit("G"), F.lit("H"))
    said = [r[0] for r in df.select(D.lexical_sentence(F.lit("P"), F.col("n"), F.col("title"), F.col("year"), F.col("matched"), F.when(F.col("n") > 3, fields).otherwise(F.expr("array_repeat('', 0)")))).collect()]
    assert said[1:] == ["Preporučeno jer P ima 3 rada koji dijele pojmove „x”, „y” — npr. „B”.", "P mentorira 7 radova iz područja F i G koji se podudaraju s tvojom temom.", "P mentorira 2 rada iz srodnih područja koji se podudaraju s tvojom temom."]
    title = lambda *x: spark.range(1).select(D.listed_title(*map(F.lit, x)), D.detail_title(*map(F.lit, x))).first()
    assert tuple(title(" ", "b")) == (D.UNTITLED, "") and tuple(title("", "b ")) == ("b", "b") and tuple(title("", "")) == (D.UNTITLED, D.UNTITLED)


def test_six_decimals_as_sql_prints_them(spark):
    rng = np.random.default_rng(9)
    values = [0.2479025, 0.2475385, 0.3179085, 0.2045815, 0.0078125, 0.0234375, 0.0, 1.0, 0.9999995, 0.9999994999, -0.2479025, 5e-7, 12345.6789015, *np.round(rng.random(3000), 7).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", D.fixed(F.col("v")))
    assert [(r[0], r[1]) for r in df.collect() if r[1] != f"{r[0]:.6f}"] == []

import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions import embedding
from corvane.functions import text as T
from corvane.functions.scoring import RankParams, calibrated, passes, recency
from corvane.operators import ranking, tables
from corvane.streaming import windows


def test_text_functions(spark):
    rows = spark.createDataFrame([("Čvor ŽELJEZO šuma ćup", "Đurđevac"), ("", "x")], "a string, b string")
    got = [tuple(r) for r in rows.select(T.fold(F.col("a")), T.fold(F.col("b")), T.fold_name(F.col("b")), T.fold_slug(F.col("b"))).collect()]
    assert got[0] == ("cvor zeljezo suma cup", "durdevac", "đurđevac", "durdevac")
    pairs = [("neuronske mreže", "neuronskih mreža", 1.0), ("grafovi", "kuhanje", 0.0), ("the and za", "the", 0.0), ("grafovi kuhanje", "teorija grafova", 0.5), ("x", None, 0.0)]
    rows = spark.createDataFrame(pairs, "q string, t string, want double")
    assert all(r[0] == r[1] for r in rows.select(T.lexical_overlap(T.content_terms(F.col("q")), T.content_terms(F.col("t"))), "want").collect())
    words = spark.createDataFrame([("Mreža mreza MREŽA Graf",)], "a string").select(T.content_words(F.col("a")).alias("w")).first()["w"]
    assert [w["surface"] for w in words] == ["Mreža", "Graf"]
    keys = spark.createDataFrame([(["Neuronske mreže", " neuronske MREŽE ", "Baze"], "neuronska mreža")], "k array<string>, q string")
    assert keys.select(T.matched_keywords(T.content_terms(F.col("q")), F.col("k"))).first()[0] == ["Neuronske mreže"]
    names = spark.createDataFrame([("Horvat,\n Ana",), ("Ana Marija Horvat",), ("Ana",), ("-",), (None,)], "n string").select(T.name_parts(F.col("n")).alias("p")).collect()
    assert [tuple(r["p"]) if r["p"] else None for r in names] == [("Horvat", "Ana"), ("Horvat", "Ana Marija"), None, None, None]


def test_scores(spark):
    p = RankParams(now_year=2026)
    rows = spark.createDataFrame([(2026,), (2022,), (2030,), (None,)], "y int").select(recency(F.col("y"), p)).collect()
    assert [r[0] for r in rows] == [1.0, 0.5, 1.0, 0.5]
    rows = spark.createDataFrame([(0.61, 0.0), (0.5, 0.2), (0.5, 0.0), (0.46, 1.0)], "s double, o double").select(passes(F.col("s"), F.col("o"), p), calibrated(F.col("s"), (0.5, 0.6))).collect()
    assert [r[0] for r in rows] == [True, True, False, False] and rows[0][1] == 1.0
    with pytest.raises(ValueError):
        RankParams(now_year=2026, top_k=51)


def test_group_score_and_ties(spark):
    vector = lambda x: [float(x), (1 - x * x) ** 0.5]
    items = spark.createDataFrame([(k, k % 2, "t", 2026, vector(0.9)) for k in range(40)] + [(99, 7, "t", 2026, vector(0.8))], "item_id long, group_id long, title string, year int, vector array<double>")
    queries = spark.createDataFrame([(1, "q", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    rows = ranking.recommend_groups(queries, items, RankParams(now_year=2026)).orderBy("place").collect()
    assert [r["group_id"] for r in rows] == [0, 1, 7]
    assert rows[0]["score"] == pytest.approx(0.9 * 12**0.25, abs=1e-6) and rows[0]["n_items"] == 20 and len(rows[0]["evidence"]) == 5
    assert rows[2]["score"] == pytest.approx(0.8, abs=1e-6)


def test_upkeep(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "s", 1.0), (2, "b", None, None)], "id int, name string, unit string, x double")
    new = spark.createDataFrame([(2, "B", "u", 5.0), (3, "c", None, None), (1, None, None, 9.0)], "id int, name string, unit string, x double")
    got = sorted(map(tuple, tables.merged(stored, new, ["id"], {"name": "set", "unit": "set_if_given", "x": "fill"}).collect()))
    assert got == [(1, None, "s", 1.0), (2, "B", "u", 5.0), (3, "c", None, None)]
    with pytest.raises(ValueError):
        tables.pruned(stored, stored.limit(0), ["id"], F.lit(True))
    with pytest.raises(ValueError):
        tables.page(stored, [F.col("id")], 0)
    assert [r["id"] for r in tables.pruned(stored, new.where("id = 2"), ["id"], F.col("name") == "a").collect()] == [2]
    path = tables.write_snapshot(stored, str(tmp_path), 3)
    assert spark.read.parquet(path).count() == 2


def test_embedding_is_incremental(spark):
    e = embedding.HashingEmbedder(16)
    rows = spark.createDataFrame([(1, "one two"), (2, ""), (3, "three")], "id long, text string")
    none = spark.createDataFrame([], "id long, model string, vector array<float>")
    first = embedding.build(rows, none, "id", "text", e)
    assert sorted(r["id"] for r in first.collect()) == [1, 3] and abs(sum(x * x for x in first.first()["vector"]) - 1) < 1e-5
    again = embedding.build(rows.union(spark.createDataFrame([(4, "four")], rows.schema)), first, "id", "text", e)
    assert sorted(r["id"] for r in again.collect()) == [1, 3, 4]


def test_streams(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1, 12, 0)
    spark.createDataFrame([("u", at + datetime.timedelta(seconds=10 * k)) for k in range(9)], "who string, at timestamp").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("who string, at timestamp").parquet(f"{tmp_path}/in")
    query = windows.rate_windows(stream, "who", "at", 4).writeStream.format("memory").queryName("limits").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["n"], r["refused"]) for r in spark.table("limits").collect()) == [(3, 0), (6, 2)]

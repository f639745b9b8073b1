import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ranking_queries, vector_index
from corvane.operators.ranking import nearest

SCHEMA = "item_id long, vector array<float>"


def recall(found, exact):
    a, b = ({(r[0], r[1]) for r in df.collect()} for df in (found, exact))
    return len(a & b) / len(b)


def clustered(n, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    raw = [centres[k % 12] + rng.normal(size=16) * 0.6 for k in range(n)]
    rows = [(k, [float(x) for x in v / np.linalg.norm(v)]) for k, v in enumerate(raw)]
    return rows + [(n + k, rows[0][1]) for k in range(copies)]


def test_recall_over_the_whole_table(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    exact = nearest(vectors.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id"), vectors, 10)
    found = ranking_queries.knn_indexed(spark, sf_dir)
    assert found.columns == ["query_id", "item_id", "similarity", "place"]
    assert recall(found.select("query_id", "item_id"), exact) >= 0.9


def test_few_cells_are_enough_and_appended_items_are_found(spark):
    rows = clustered(1_500, copies=300)
    items = spark.createDataFrame(rows[:1_200], SCHEMA)
    index = vector_index.tune(vector_index.build(items), 10)
    assert len(index.centroids) == 34 and index.nprobe < 17
    vector_index.append(index, spark.createDataFrame(rows[1_200:], SCHEMA))
    everything = spark.createDataFrame(rows, SCHEMA)
    queries = everything.where("item_id % 25 = 0").withColumnRenamed("item_id", "query_id")
    found = vector_index.search(index, queries, 10)
    exact = nearest(queries, everything, 10)
    assert recall(found.select("query_id", "item"), exact) >= 0.9
    assert {r["item"] for r in found.collect()} & set(range(1_200, 1_500))
    all_cells = vector_index.search(index._replace(nprobe=len(index.centroids)), queries, 10)
    similarity = lambda df, item: {(r["query_id"], r["place"]): r["similarity"] for r in df.collect()}
    got, want = similarity(all_cells, "item"), similarity(exact, "item_id")
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=2e-3) for x in want)


def test_cells_that_nobody_asks_for_are_not_read(spark):
    index = vector_index.build(spark.createDataFrame(clustered(400), SCHEMA))._replace(nprobe=1)
    one = spark.createDataFrame(clustered(1), SCHEMA).withColumnRenamed("item_id", "query_id")
    plan = vector_index.search(index, one, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan
    assert vector_index.search(index, one, 3).where("place = 1").first()["item"] == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "QUERIES", 20)
    items = spark.createDataFrame(clustered(200), SCHEMA)
    index = vector_index.build(items)
    queries = items.withColumnRenamed("item_id", "query_id").limit(50)
    assert recall(vector_index.search(index, queries, 5).select("query_id", "item"), nearest(queries, items, 5)) > 0.99


def test_edges(spark):
    index = vector_index.tune(vector_index.build(spark.createDataFrame([(1, None)], SCHEMA)), 3)
    query = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, vector array<float>")
    assert vector_index.search(index, query, 3).collect() == []
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0])]
    index = vector_index.build(spark.createDataFrame(rows, SCHEMA))._replace(nprobe=9)
    assert [(r["query_id"], r["item"], r["similarity"]) for r in vector_index.search(index, query, 9).orderBy("place").collect()] == [(7, 1, 1.0), (7, 1, 1.0), (7, 2, 0.0), (7, 4, -1.0)]
    with pytest.raises(Exception, match="dimensions"):
        vector_index.append(index, spark.createDataFrame([(9, [1.0])], SCHEMA))

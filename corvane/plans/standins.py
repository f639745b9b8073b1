"""The driver tables in the roles of the library's tables; the same derivations in SQL, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.scoring import RankParams

GROUPS = 40
#: The test vectors are further apart than a dense encoder's, so the floors are lower.
PARAMS = RankParams(now_year=2026, floor=0.10, strong=0.20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector: item_id, group_id, title (the first line), body, kind, source, field, year, keywords, vector."""
    docs = table(spark, sf_dir, "documents")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return facts(docs).join(vectors, "item_id")


def facts(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return docs.select(
        i.alias("item_id"),
        (i % GROUPS).alias("group_id"),
        F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.when(i % 3 == 0, "zavrsni").when(i % 3 == 1, "diplomski").otherwise("doktorski").alias("kind"),
        F.when(i % 5 == 0, "schedule").otherwise("repo").alias("source"),
        F.col("lang").alias("field"),
        F.when(i % 17 != 0, 2000 + i % 27).cast("int").alias("year"),
        F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w) >= 9), 1, 4).alias("keywords"),
    )


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as queries, each with the vector of its number."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "text", "vector")


FACTS = f"""facts AS (
  SELECT doc_id AS item_id, doc_id % {GROUPS} AS group_id, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body,
         CASE doc_id % 3 WHEN 0 THEN 'zavrsni' WHEN 1 THEN 'diplomski' ELSE 'doktorski' END AS kind,
         CASE WHEN doc_id % 5 = 0 THEN 'schedule' ELSE 'repo' END AS source, lang AS field,
         CASE WHEN doc_id % 17 <> 0 THEN CAST(2000 + doc_id % 27 AS INTEGER) END AS year,
         list_filter(string_split(coalesce(text, ''), ' '), lambda w: length(w) >= 9)[1:4] AS keywords
  FROM documents)"""
ITEMS = f"{FACTS}, items AS (SELECT f.*, e.embedding::DOUBLE[] AS v FROM facts f JOIN embeddings e ON e.vec_id = f.item_id)"
SEARCHES = "searches AS (SELECT b.item_id AS query_id, b.text, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"

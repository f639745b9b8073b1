"""Ranking queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import display as D
from corvane.functions import scoring as S
from corvane.functions import text as T
from corvane.operators import lexical, ranking, vector_index
from corvane.plans import sql
from corvane.plans.standins import FACTS, GROUPS, ITEMS, PARAMS, SEARCHES, facts, items, searches, table

P = PARAMS


def knn_topk(spark, sf_dir: str) -> DataFrame:
    return ranking.nearest(searches(spark, sf_dir), items(spark, sf_dir), P.pool)


def knn_indexed(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each vector whose id is divisible by 100, by an inverted-file index of all of them."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    index = vector_index.tune(vector_index.build(vectors), 10)
    asked = vectors.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    return vector_index.search(index, asked, 10).withColumnRenamed("item", "item_id")


def knn_floor(spark, sf_dir: str) -> DataFrame:
    return knn_topk(spark, sf_dir).where(F.col("similarity") >= P.floor).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))


def l2_norm(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 6).alias("norm"))


def recommend_groups(spark, sf_dir: str) -> DataFrame:
    found = ranking.recommend_groups(searches(spark, sf_dir), items(spark, sf_dir), P)
    shown = F.transform("evidence", lambda x: F.concat_ws(":", x["item_id"].cast("string"), D.fixed(x["similarity"])))
    return found.select("query_id", "place", "group_id", "score", "n_items", F.array_join(shown, ",").alias("evidence"))


def filtered_groups(spark, sf_dir: str) -> DataFrame:
    """The same with hard filters: a field, matched without case, and a kind; the filters reach the scan."""
    chosen = items(spark, sf_dir).where(F.col("field").ilike("%E%") & (F.col("kind") == "diplomski"))
    return ranking.recommend_groups(searches(spark, sf_dir), chosen, P).select("query_id", "place", "group_id", "score", "n_items")


def recommend_courses(spark, sf_dir: str) -> DataFrame:
    stock = items(spark, sf_dir)
    eligible = table(spark, sf_dir, "part").where("p_size % 2 = 1").select(F.col("p_partkey").alias("item_id"))
    return ranking.recommend_items(searches(spark, sf_dir), stock, eligible, S.RankParams(now_year=P.now_year, floor=P.floor, strong=P.strong, lexical_weight=0.06, top_k=12))


def centroids(spark, sf_dir: str) -> DataFrame:
    found = ranking.centroids(items(spark, sf_dir))
    return found.select("group_id", F.size("centroid").alias("dimensions"), F.round(S.norm(F.col("centroid")), 6).alias("norm"), F.round(F.col("centroid")[0], 6).alias("first"))


def similar_groups(spark, sf_dir: str) -> DataFrame:
    return ranking.similar_groups(items(spark, sf_dir))


def lexical_overlap(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item, as a query, against the titles of all documents: the pairs with a common term."""
    queries = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(T.content_terms(F.col("text")))).alias("terms"))
    titles = facts(table(spark, sf_dir, "documents")).select(F.col("item_id").alias("doc_id"), T.content_terms(F.col("title")).alias("words"))
    return lexical.overlaps(queries, titles, "item_id", "doc_id")


def explanation(spark, sf_dir: str) -> DataFrame:
    """The sentence that explains the first group of each query."""
    first = ranking.recommend_groups(searches(spark, sf_dir), items(spark, sf_dir), P).where("place = 1")
    titles = facts(table(spark, sf_dir, "documents")).select("item_id", "title")
    top = first.select("query_id", "group_id", F.least(F.size("evidence"), F.lit(P.shown)).alias("k"), F.col("evidence")[0]["item_id"].alias("item_id"), F.col("evidence")[0]["year"].alias("year"))
    year = F.when(F.col("year").isNotNull(), F.concat(F.lit(" ("), F.col("year"), F.lit(")"))).otherwise("")
    form = F.when(F.col("k") == 1, "rad").when(F.col("k").between(2, 4), "rada").otherwise("radova")
    # The wording of the sentence.
    said = F.concat(F.lit("Preporučeno jer "), F.concat(F.lit("Group "), F.col("group_id")), F.lit(" ima "), F.col("k"), F.lit(" "), form, F.lit(" na sličnu temu, npr. „"), F.col("title"), F.lit("”"), year, F.lit("."))
    return top.join(titles, "item_id").select("query_id", said.alias("explanation"))


def decay_score(spark, sf_dir: str) -> DataFrame:
    """Sums of similarities that decay by place, with a small bonus for recent years: the lexical mode's group score."""
    from pyspark.sql import Window

    pool = knn_topk(spark, sf_dir).where(F.col("similarity") > 0).join(facts(table(spark, sf_dir, "documents")).select("item_id", "group_id", "year"), "item_id")
    w = Window.partitionBy("query_id", "group_id").orderBy("place")
    bonus = 1 + F.greatest(F.lit(0), F.lit(5) - (F.lit(P.now_year) - F.coalesce("year", F.lit(0)))) * 0.02
    term = F.col("similarity") * bonus * F.pow(F.lit(0.6), F.row_number().over(w) - 1)
    summed = pool.withColumn("term", term).groupBy("query_id", "group_id").agg(F.sum("term").alias("total"), F.count("*").alias("n"))
    return summed.select("query_id", "group_id", "n", F.round(F.col("total") / F.greatest(F.lit(1), F.least("n", F.lit(3))), 5).alias("score"))


QUERIES = {f.__name__: f for f in (knn_topk, knn_indexed, knn_floor, l2_norm, recommend_groups, filtered_groups, recommend_courses, centroids, similar_groups, lexical_overlap, explanation, decay_score)}


def _knn(where: str = "true", k: int = P.pool, source: str = "items", name: str = "knn") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS place FROM (
    SELECT q.query_id, i.item_id, round(list_dot_product(q.v, i.v), 9) AS similarity FROM searches q, {source} i WHERE {where})) WHERE place <= {k})"""


def _groups(where: str = "true") -> str:
    return f"""{ITEMS}, {SEARCHES}, {_knn(where)},
qt AS (SELECT query_id, {sql.terms("text")} AS q FROM searches),
it AS (SELECT item_id, group_id, year, title, keywords, {sql.terms("title || ' ' || array_to_string(keywords, ' ')")} AS t FROM items),
hits AS (
  SELECT k.query_id, k.item_id, k.place, i.group_id, i.year, similarity, round(similarity + {P.lexical_weight} * ({sql.overlap("q", "t")}), 9) AS hybrid
  FROM knn k JOIN it i USING (item_id) JOIN qt USING (query_id) WHERE similarity >= {P.floor}),
weighted AS (SELECT *, round(hybrid * CASE WHEN year IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, {P.now_year} - year) / 4.0) END, 9) AS weighted FROM hits),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY weighted DESC, place) AS by_weight,
         row_number() OVER (PARTITION BY query_id, group_id ORDER BY hybrid DESC, place) AS by_hybrid FROM weighted),
grouped AS (
  SELECT query_id, group_id, round(avg(weighted) FILTER (by_weight <= 12) * pow(count(*) FILTER (by_weight <= 12), 0.25), 6) AS score, count(*) AS n_items, min(place) AS first_place,
         string_agg(item_id || ':' || format('{{:.6f}}', similarity), ',' ORDER BY by_hybrid) FILTER (by_hybrid <= 5) AS evidence
  FROM ranked GROUP BY query_id, group_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_place) AS final FROM grouped) WHERE final <= {P.top_k})"""


_STEMS = lambda x: f"list_distinct(list_transform({x}, lambda w: left(w, 3)))"
SQL = {
    "knn_topk": f"WITH {ITEMS}, {SEARCHES}, {_knn()} SELECT query_id, item_id, similarity, place FROM knn",
    "knn_floor": f"WITH {ITEMS}, {SEARCHES}, {_knn()} SELECT query_id, count(*) AS n, round(max(similarity), 6) AS best FROM knn WHERE similarity >= {P.floor} GROUP BY query_id",
    "l2_norm": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
    "recommend_groups": f"WITH {_groups()} SELECT query_id, final AS place, group_id, score, n_items, evidence FROM best",
    "filtered_groups": f"WITH {_groups(chr(39).join(['i.field ILIKE ', '%E%', ' AND i.kind = ', 'diplomski', '']))} SELECT query_id, final AS place, group_id, score, n_items FROM best",
    "recommend_courses": f"""WITH {ITEMS}, {SEARCHES}, stock AS (SELECT * FROM items WHERE item_id IN (SELECT p_partkey FROM part WHERE p_size % 2 = 1)), {_knn("true", 120, "stock")},
qt AS (SELECT query_id, {sql.terms("text")} AS q FROM searches),
it AS (SELECT item_id, body, {sql.terms("title")} AS t, {sql.terms("body")} AS b, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS flat FROM stock),
scored AS (
  SELECT query_id, item_id, place, body, flat, round(similarity + 0.06 * ({sql.overlap("q", "t")}), 9) AS score
  FROM knn JOIN it USING (item_id) JOIN qt USING (query_id) WHERE similarity >= {P.strong} OR (similarity >= {P.floor} AND ({sql.overlap("q", "b")}) > 0))
SELECT query_id, final AS place, item_id, score, CASE WHEN body = '' THEN NULL WHEN length(flat) <= 220 THEN flat ELSE regexp_replace(left(flat, 220), ' [^ ]*$', '') || '…' END AS snippet
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS final FROM scored) WHERE final <= 12""",
    "centroids": f"""WITH {ITEMS}, parts AS (SELECT group_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM items), means AS (SELECT group_id, i, round(avg(x), 9) AS x FROM parts GROUP BY group_id, i)
SELECT group_id, CAST(count(*) AS INTEGER) AS dimensions, round(sqrt(sum(x * x)), 6) AS norm, round(max(x) FILTER (i = 0), 6) AS first FROM means GROUP BY group_id""",
    "similar_groups": f"""WITH {ITEMS}, parts AS (SELECT group_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM items), means AS (SELECT group_id, i, round(avg(x), 9) AS x FROM parts GROUP BY group_id, i),
c AS (SELECT group_id, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM means GROUP BY group_id),
pairs AS (SELECT a.group_id, b.group_id AS other_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS similarity FROM c a JOIN c b ON a.group_id <> b.group_id)
SELECT group_id, place, other_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY similarity DESC, other_id) AS place FROM pairs) WHERE place <= 6""",
    "lexical_overlap": f"""WITH {FACTS}, q AS (SELECT item_id, {sql.terms("text")} AS q FROM benchmark), d AS (SELECT item_id AS doc_id, {sql.terms("title")} AS t FROM facts)
SELECT item_id, doc_id, round({sql.overlap("q", "t")}, 6) AS overlap FROM q, d WHERE ({sql.overlap("q", "t")}) > 0""",
    "explanation": f"""WITH {_groups()}, top AS (SELECT query_id, group_id, least(n_items, 5) AS k, CAST(string_split(string_split(evidence, ',')[1], ':')[1] AS BIGINT) AS item_id FROM best WHERE final = 1)
SELECT query_id, 'Preporučeno jer Group ' || top.group_id || ' ima ' || k || ' ' || CASE WHEN k = 1 THEN 'rad' WHEN k BETWEEN 2 AND 4 THEN 'rada' ELSE 'radova' END || ' na sličnu temu, npr. „' || title || '”' || coalesce(' (' || year || ')', '') || '.' AS explanation
FROM top JOIN facts USING (item_id)""",
    "decay_score": f"""WITH {ITEMS}, {SEARCHES}, {_knn()},
terms AS (
  SELECT k.query_id, f.group_id, similarity * (1 + greatest(0, 5 - ({P.now_year} - coalesce(year, 0))) * 0.02::DOUBLE) * pow(0.6::DOUBLE, row_number() OVER (PARTITION BY k.query_id, f.group_id ORDER BY place) - 1) AS term
  FROM knn k JOIN facts f USING (item_id) WHERE similarity > 0)
SELECT query_id, group_id, count(*) AS n, round(sum(term) / greatest(1, least(count(*), 3)), 5) AS score FROM terms GROUP BY query_id, group_id""",
}

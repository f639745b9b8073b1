"""Hybrid vector and lexical ranking: nearest items, grouped recommendations, eligible items, similar groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.scoring import RankParams, cosine, passes, recency, unit
from corvane.operators.rounds import saved

#: Queries whose vectors are sent to the tasks at once, and that a task compares at once.
BLOCK, TOGETHER = 10_000, 256


class _Best:
    """The k best items of each of some queries, of what has been seen so far: largest similarity, then smallest id."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, k: int):
        self.names, self.vectors, self.k = names, vectors, k
        self.query, self.item, self.similarity = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(names), -np.inf)  # what the k-th best item has

    def add(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        found = np.round(matrix @ self.vectors.T, 9)
        least = self.least
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(found, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero(found >= least)
        query, item, similarity = np.concatenate([self.query, query]), np.concatenate([self.item, ids[row]]), np.concatenate([self.similarity, found[row, query]])
        order = np.lexsort((item, -similarity, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.item, self.similarity = query[kept], item[order][kept], similarity[order][kept]
        full = place[kept] == self.k - 1
        self.least[self.query[full]] = self.similarity[full]


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows (id, vector), and their vectors as the rows of a matrix."""
    ids, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    return ids, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _local(items: DataFrame, item: str, vector: str, names: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(query, item, similarity): of each task, the k best items of each query."""
    shared = items.sparkSession.sparkContext.broadcast((names, vectors))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = shared.value
        held = [_Best(names[at : at + TOGETHER], vectors[at : at + TOGETHER], k) for at in range(0, len(names), TOGETHER)]
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                lists = part.column(1)
                if held and any(n != vectors.shape[1] for n in pa.compute.unique(pa.compute.list_value_length(lists)).to_pylist()):
                    raise ValueError(f"a vector that hasn't {vectors.shape[1]} dimensions")
                matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                for block in held:
                    block.add(part.column(0).to_numpy(), matrix)
        for block in held:
            yield pa.record_batch([pa.array(block.names[block.query]), pa.array(block.item), pa.array(block.similarity)], ["query", "item", "similarity"])

    rows = items.select(F.col(item).cast("long"), vector).where(F.col(vector).isNotNull())
    return rows.mapInArrow(best, "query long, item long, similarity double")


def nearest(queries: DataFrame, items: DataFrame, k: int, query: str = "query_id", item: str = "item_id", vector: str = "vector") -> DataFrame:
    """(query, item, similarity, place): the k items of each query with the largest cosine; ties go to the smaller id.

    The vectors of at most BLOCK queries go to every task; a task keeps its k best of each query, so what is shuffled grows
    with the number of tasks, not of items. More queries are taken block by block, each a scan of the items whose result
    is kept as a table. Filters on items reach their scan.
    """
    asked = queries.select(F.col(query).cast("long").alias("query"), F.col(vector).alias("vector")).where(F.col(vector).isNotNull())
    total = asked.count()
    blocks = -(-total * 2 // BLOCK) if total > BLOCK else 1  # half full, so that chance fills none beyond BLOCK
    found = None
    for number in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number)
        local = _local(items, item, vector, *_matrix(part.toArrow()), k)
        local = local if blocks == 1 else saved(local)
        found = local if found is None else found.unionByName(local)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return found.withColumn("place", place).where(F.col("place") <= k).select(F.col("query").alias(query), F.col("item").alias(item), "similarity", "place")


def _with_terms(items: DataFrame, pool: DataFrame, **texts: Column) -> DataFrame:
    """The items of a pool, without vectors, with the content terms of texts, by name: once an item, not once a query and item."""
    met = items.join(pool.select("item_id").distinct(), "item_id", "left_semi")
    for name, text in texts.items():
        met = met.select("*", F.explode(F.array(T.content_terms(text))).alias(f"{name}_terms"))
    return met.drop("vector")


def _titles(items: DataFrame) -> Column:
    """An item's titles and keywords, as far as items have them, as one text."""
    parts = [F.col(c) for c in ("title", "title_en") if c in items.columns]
    return F.concat_ws(" ", *parts, *([F.array_join("keywords", " ")] if "keywords" in items.columns else []))


def hits(queries: DataFrame, items: DataFrame, p: RankParams) -> DataFrame:
    """Items of the pool above the floor on the pure similarity, with the hybrid one and the recency-weighted one."""
    terms = queries.select("query_id", T.content_terms(F.col("text")).alias("terms"))
    pool = nearest(queries, items, p.pool).where(F.col("similarity") >= p.floor)
    joined = pool.join(_with_terms(items, pool, title=_titles(items)), "item_id").join(terms, "query_id")
    overlap = T.lexical_overlap(F.col("terms"), F.col("title_terms"))
    hybrid = F.round(F.col("similarity") + p.lexical_weight * overlap, 9)
    return joined.withColumn("hybrid", hybrid).withColumn("weighted", F.round(F.col("hybrid") * recency(F.col("year"), p), 9))


def recommend_groups(queries: DataFrame, items: DataFrame, p: RankParams) -> DataFrame:
    """The best groups of each query, with evidence.

    queries: query_id, text, vector; items: item_id, group_id, title, year, vector. A group's score is the mean of its
    best weighted similarities times a power of their number. Evidence shows the pure similarity in order of the hybrid one.
    """
    found = hits(queries, items, p)
    of_group = Window.partitionBy("query_id", "group_id")
    ranked = found.select(
        "*",
        F.row_number().over(of_group.orderBy(F.desc("weighted"), "place")).alias("by_weight"),
        F.row_number().over(of_group.orderBy(F.desc("hybrid"), "place")).alias("by_hybrid"),
    )
    counts = F.col("by_weight") <= p.contributing
    evidence = F.when(F.col("by_hybrid") <= p.shown, F.struct("by_hybrid", "item_id", "similarity", "year"))
    grouped = ranked.groupBy("query_id", "group_id").agg(
        (F.avg(F.when(counts, F.col("weighted"))) * F.pow(F.count_if(counts).cast("double"), F.lit(p.exponent))).alias("raw"),
        F.count("*").alias("n_items"),
        F.min("place").alias("first_place"),
        F.array_sort(F.collect_list(evidence)).alias("evidence"),
    )
    scored = grouped.withColumn("score", F.round("raw", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first_place"))
    return scored.withColumn("place", place).where(F.col("place") <= p.top_k).select("query_id", "place", "group_id", "score", "n_items", "evidence")


def recommend_items(queries: DataFrame, items: DataFrame, eligible: DataFrame, p: RankParams, pool_factor: int = 10) -> DataFrame:
    """The best eligible items of each query: filter, pool, relevance gate, a small bonus for terms in the title.

    eligible: item_id of the items that may be shown. The gate's overlap counts the whole text, the bonus only the title.
    """
    allowed = items.join(eligible.select("item_id").distinct(), "item_id", "left_semi")
    terms = queries.select("query_id", T.content_terms(F.col("text")).alias("terms"))
    pool = nearest(queries, allowed, p.top_k * pool_factor)
    joined = pool.join(_with_terms(allowed, pool, title=F.col("title"), body=F.col("body")), "item_id").join(terms, "query_id")
    whole = T.lexical_overlap(F.col("terms"), F.col("body_terms"))
    title = T.lexical_overlap(F.col("terms"), F.col("title_terms"))
    scored = joined.where(passes(F.col("similarity"), whole, p)).withColumn("score", F.round(F.col("similarity") + p.lexical_weight * title, 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place"))
    return scored.withColumn("final", place).where(F.col("final") <= p.top_k).select("query_id", F.col("final").alias("place"), "item_id", "score", T.snippet(F.col("body")).alias("snippet"))


def joined_pool(queries: DataFrame, items: DataFrame, offerings: DataFrame, limit: int) -> DataFrame:
    """(query_id, item_id, similarity, semesters, semester) of the items in the first limit rows of items joined with offerings.

    offerings: item_id, semester; an item has a row for each, and the limit counts those rows, in order of similarity, id and
    semester. Then each item is one row again, with its best similarity, all its semesters, and the first.
    """
    pool = nearest(queries, items.join(offerings.select("item_id").distinct(), "item_id", "left_semi"), limit)
    rows = pool.join(offerings, "item_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id", "semester"))
    kept = rows.withColumn("row", place).where(F.col("row") <= limit)
    semesters = F.array_sort(F.collect_set("semester")).alias("semesters")
    return kept.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"), semesters, F.min("semester").alias("semester"))


def centroids(items: DataFrame) -> DataFrame:
    """(group_id, centroid): the mean vector of each group, summed by position so that no group is gathered whole."""
    parts = items.select("group_id", F.posexplode("vector").alias("position", "value")).groupBy("group_id", "position").agg(F.avg(F.col("value").cast("double")).alias("value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: F.round(x["value"], 9))
    return parts.groupBy("group_id").agg(listed.alias("centroid"))


def similar_groups(items: DataFrame, top_k: int = 6) -> DataFrame:
    """For each group the groups whose centroids are nearest to its own by cosine."""
    units = saved(centroids(items).select(F.col("group_id").alias("query_id"), unit(F.col("centroid")).alias("vector")))
    found = nearest(units, units.withColumnRenamed("query_id", "item_id"), top_k + 1).where("query_id <> item_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id"))
    return found.withColumn("place", place).where(F.col("place") <= top_k).select(F.col("query_id").alias("group_id"), "place", F.col("item_id").alias("other_id"), "similarity")


__all__ = ["centroids", "cosine", "hits", "nearest", "recommend_groups", "recommend_items", "similar_groups"]

"""An inverted-file index of vectors: a search compares a query with the items of a few cells instead of all.

A cell is the set of items nearest to one of the coarse centroids, which rounds of k-means over a bounded sample find. The index is a
Parquet table partitioned by cell: each item's id, its vector in one byte a dimension, and the vector itself. A search ranks the
centroids for each query, reads the cells that any query asks for (the others' files are never opened), compares each cell only with the
queries that ask for it, by the bytes, and ranks the best of each query once more by the whole vectors. How many cells a query needs
is measured, not guessed: tune() takes the exact neighbours of some items and sees how far down their cells stand.

All rows are indexed, later ones too: append() deals them to the cells that are there. What every task gets is bounded:
CELLS centroids, the vectors of QUERIES queries, and the ids of QUERIES * k * SPARE candidates. A cell that holds a third of all
items is a third of all files; its tasks are split as any scan is.

Edge cases: null vectors are neither indexed nor searched for; a vector of other dimensions is an error; ids that repeat are indexed as often;
an empty table gives an index that finds nothing; zero vectors have a similarity of 0 with everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.ranking import _matrix, nearest
from corvane.operators.rounds import folder

#: Vectors that the centroids are fit on, rounds of it, and centroids at most.
SAMPLE, ROUNDS, CELLS = 200_000, 6, 16_384
#: Queries that are searched for at once.
QUERIES = 10_000
#: Candidates by bytes for each place of the result.
SPARE = 4
#: Items whose exact neighbours tell how many cells a search needs, and the share of neighbours that it shall find.
PROBES, RECALL = 200, 0.97


class VectorIndex(NamedTuple):
    """The folder of the table, the centroids (unit length), and how many cells a search looks into."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    nprobe: int

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("item long, bytes binary, vector array<float>, cell int").parquet(self.path)


def _units(lists: pa.Array) -> np.ndarray:
    """Vectors of unit length, as the rows of a matrix; zero vectors stay."""
    size = pc.unique(pc.list_value_length(lists)).to_pylist()
    if len(size) > 1:
        raise ValueError(f"vectors of different dimensions: {sorted(size)}")
    matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)
    length = np.sqrt(np.square(matrix, dtype=np.float64).sum(axis=1))
    return (matrix / np.where(length > 0, length, 1)[:, None]).astype(np.float32)


def _nearest_cells(units: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(units), np.int32)
    for low in range(0, len(units), 4096):
        out[low : low + 4096] = np.argmax(units[low : low + 4096] @ centroids.T, axis=1)
    return out


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round of k-means: each centroid moves to the mean of its vectors; tasks send sums."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total = np.zeros(held.shape)
        for batch in batches:
            units = _units(batch.column(0))
            if len(units):
                cell = _nearest_cells(units, held)
                order = np.argsort(cell, kind="stable")
                kinds, first = np.unique(cell[order], return_index=True)
                total[kinds] += np.add.reduceat(units[order].astype(np.float64), first)
        filled = np.flatnonzero(total.any(axis=1))
        yield pa.record_batch([pa.array(filled, pa.int32()), pa.array(list(total[filled]), pa.list_(pa.float64()))], ["cell", "sums"])

    parts = vectors.mapInArrow(summed, "cell int, sums array<double>").select("cell", F.posexplode("sums").alias("position", "value"))
    sums = parts.groupBy("cell", "position").agg(F.sum("value").alias("value")).toArrow()
    new = centroids.copy()
    found = np.zeros(centroids.shape)
    found[sums.column("cell").to_numpy(), sums.column("position").to_numpy()] = sums.column("value").to_numpy()
    length = np.linalg.norm(found, axis=1)
    new[length > 0] = (found[length > 0] / length[length > 0, None]).astype(np.float32)  # one without vectors stays where it is
    return new


def _dealt(items: DataFrame, item: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """The rows of the index table of some items."""
    shared = items.sparkSession.sparkContext.broadcast(centroids)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _units(batch.column(1))
            if len(units) and units.shape[1] != shared.value.shape[1]:
                raise ValueError(f"a vector that hasn't {shared.value.shape[1]} dimensions")
            most = np.abs(units).max(axis=1, initial=0)
            small = np.round(units * (127 / np.where(most > 0, most, 1))[:, None]).astype(np.int8)
            head = most.astype("<f4")[:, None].view(np.int8)  # the scale stands before the bytes
            raw = np.concatenate([head, small], axis=1)
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(list(units), pa.list_(pa.float32())), pa.array(_nearest_cells(units, shared.value) if len(units) else [], pa.int32())], ["item", "bytes", "vector", "cell"])

    rows = items.select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("vector").isNotNull())
    return rows.mapInArrow(deal, "item long, bytes binary, vector array<float>, cell int")


def append(index: VectorIndex, items: DataFrame, item: str = "item_id", vector: str = "vector") -> None:
    """Deal more items to the cells that are there; searches find them from now on."""
    rows = _dealt(items, item, vector, index.centroids)
    # one file a cell and part of it, so that a cell of any size is written by many tasks
    rows.repartition("cell", F.pmod(F.xxhash64("item"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(index.path)


def build(items: DataFrame, item: str = "item_id", vector: str = "vector", cells: int | None = None, path: str | None = None) -> VectorIndex:
    """Fit the centroids on at most SAMPLE vectors (those of the least hash of their id) and index all items."""
    spark = items.sparkSession
    given = items.select(F.col(item).alias("item"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("vector").isNotNull())
    total = given.count()
    cells = cells or max(1, min(CELLS, math.isqrt(total)))
    sample = given.orderBy(F.xxhash64("item"), "item").limit(SAMPLE).select("vector")
    first = sample.limit(cells).toArrow().column(0).combine_chunks() if total else None
    centroids = _units(first) if total else np.zeros((0, 0), np.float32)
    if total:
        kept = folder(spark)
        sample.write.parquet(kept)
        sample = spark.read.schema("vector array<float>").parquet(kept)
        for _ in range(ROUNDS):
            centroids = _moved(sample, centroids)
    index = VectorIndex(spark, path or folder(spark), centroids, len(centroids))
    if total:
        append(index, items, item, vector)
    else:
        spark.createDataFrame([], "item long, bytes binary, vector array<float>, cell int").write.partitionBy("cell").parquet(index.path)
    return index


def tune(index: VectorIndex, k: int, recall: float = RECALL) -> VectorIndex:
    """The index with as few cells a search as find a share of the exact k neighbours of PROBES of its items."""
    if not len(index.centroids):
        return index
    rows = index.rows.select("item", "vector")
    asked = rows.dropDuplicates(["item"]).orderBy(F.xxhash64("item", F.lit(7)), "item").limit(PROBES)
    asked = asked.withColumnRenamed("item", "query")
    exact, asked_at = nearest(asked, rows, k, query="query", item="item"), asked.toArrow()
    names, units = asked_at.column("query").to_numpy(), _units(asked_at.column("vector").combine_chunks())
    place_of = {int(q): np.argsort(np.argsort(-(units[i] @ index.centroids.T), kind="stable")) for i, q in enumerate(names)}
    cells = exact.join(index.rows.select("item", "cell").distinct(), "item").select("query", "cell").toArrow()
    depth = np.array([place_of[q][c] for q, c in zip(cells.column("query").to_pylist(), cells.column("cell").to_pylist(), strict=True)])
    nprobe = int(np.quantile(depth, recall, method="higher")) + 1 if len(depth) else len(index.centroids)
    return index._replace(nprobe=nprobe)


class _Asked(NamedTuple):
    """The queries of a block: ids, unit vectors, and for each cell the queries that ask for it."""

    names: np.ndarray
    units: np.ndarray
    of_cell: dict[int, np.ndarray]


def _best(query: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each query: greatest score, then smallest id."""
    order = np.lexsort((item, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[place < k]


def _scan(shared, k: int):
    """By bytes: the k best of each query of a task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: _Asked = shared.value
        query, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.int8).reshape(batch.num_rows, -1)
            scale = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0] / 127
            cell, ids = batch.column("cell").to_numpy(), batch.column("item").to_numpy()
            for c in np.unique(cell):
                at, mine = np.flatnonzero(cell == c), asked.of_cell.get(int(c))
                if mine is None:
                    continue
                for low in range(0, len(mine), 512):
                    some = mine[low : low + 512]
                    found = (raw[at, 4:].astype(np.float32) @ asked.units[some].T) * scale[at, None]
                    row, column = np.nonzero(found >= (np.partition(found, len(at) - k, axis=0)[len(at) - k] if len(at) > k else -np.inf))
                    query, item, score = np.concatenate([query, some[column]]), np.concatenate([item, ids[at][row]]), np.concatenate([score, found[row, column]])
                if len(query) > 4 * k * len(asked.names):
                    kept = _best(query, item, score, k)
                    query, item, score = query[kept], item[kept], score[kept]
        kept = _best(query, item, score, k)
        yield pa.record_batch([pa.array(query[kept]), pa.array(item[kept]), pa.array(score[kept])], ["query", "item", "score"])

    return scan


def _rank(shared, wanted):
    """By whole vectors: the similarity of each candidate pair (query, item)."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, (item, query) = shared.value, wanted.value
        for batch in batches:
            ids = batch.column("item").to_numpy()
            low, high = np.searchsorted(item, ids, "left"), np.searchsorted(item, ids, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            units = _units(batch.column("vector").take(pa.array(hit))).astype(np.float64)
            row = np.repeat(np.arange(len(hit)), (high - low)[hit])
            own = query[np.concatenate([np.arange(a, b) for a, b in zip(low[hit], high[hit], strict=True)])]
            similarity = np.round(np.einsum("ij,ij->i", units[row], asked.units[own].astype(np.float64)), 9)
            yield pa.record_batch([pa.array(asked.names[own]), pa.array(ids[hit][row]), pa.array(similarity)], ["query", "item", "similarity"])

    return rank


def _searched(index: VectorIndex, asked: pa.Table, k: int) -> DataFrame:
    """(query, item, similarity) of the candidates of a block of queries."""
    spark = index.spark
    names, matrix = _matrix(asked)
    units = (matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None]).astype(np.float32)
    of_cell: dict[int, list] = {}
    for low in range(0, len(names), 1024):
        near = np.argsort(-(units[low : low + 1024] @ index.centroids.T), axis=1, kind="stable")[:, : index.nprobe]
        for q, cells in enumerate(near.tolist()):
            for c in cells:
                of_cell.setdefault(c, []).append(low + q)
    shared = spark.sparkContext.broadcast(_Asked(names, units, {c: np.array(q) for c, q in of_cell.items()}))
    rows = index.rows.where(F.col("cell").isin(list(of_cell)))  # only their folders are read
    candidates = rows.select("item", "bytes", "cell").mapInArrow(_scan(shared, k * SPARE), "query long, item long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    best = candidates.distinct().withColumn("n", place).where(F.col("n") <= k * SPARE).select("item", "query").toArrow()
    item, query = best.column("item").to_numpy(), best.column("query").to_numpy()
    order = np.argsort(item, kind="stable")
    wanted = spark.sparkContext.broadcast((item[order], query[order]))
    return rows.select("item", "vector").mapInArrow(_rank(shared, wanted), "query long, item long, similarity double")


def search(index: VectorIndex, queries: DataFrame, k: int, query: str = "query_id", vector: str = "vector") -> DataFrame:
    """(query, item, similarity, place): the k best of the cells that each query looks into; ties go to the smaller id."""
    asked = queries.select(F.col(query).cast("long").alias("query"), F.col(vector).alias("vector")).where(F.col("vector").isNotNull())
    total = asked.count()
    blocks = -(-total * 2 // QUERIES) if total > QUERIES else 1
    found = None
    for number in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == number)
        rows = _searched(index, part.toArrow(), k) if len(index.centroids) else index.spark.createDataFrame([], "query long, item long, similarity double")
        found = rows if found is None else found.unionByName(rows)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return found.withColumn("place", place).where(F.col("place") <= k).select(F.col("query").alias(query), "item", "similarity", "place")

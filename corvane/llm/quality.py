"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features are indicators (present or not) of byte trigrams and of lower-cased words and word pairs, hashed to a fixed number
of columns. Each indicator is scaled by its class log-count ratio, a document's features have unit length, and
a linear hinge-loss model is fit to them by dual coordinate descent. A score is the logistic of the margin.

The fit reads at most MOST labelled documents (those with the smallest hash of doc_id among the labelled rows whose
crc32(doc_id) mod 3 is not 1), one row of each, in that order as long as they have FEATURES indicators in all; so the cost of
the one task that fits, and the one broadcast, of that many ids, are bounded whatever the corpus. The model is one row of 2 ** BITS * 2 weights. Every text is scored whole.

Edge cases: null and empty texts have no feature and get the intercept's score; a doc_id with several labels counts as
the lowest of them, and one with several texts as the least of those; without any label of either class every score is 0.5; repeated rows each get a row; an empty table
gives no rows; more columns, whatever their names, are kept by kept() and by rated() (which puts its own score in place of a column of
that name) and ignored by the query; very long texts are a pass of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import saved, table

#: Labelled documents that a fit reads at most.
MOST = 12_000
#: Indicators of all of them at most: the fit holds 8 bytes of each.
FEATURES = 100_000_000
#: Of the columns of each of the two kinds of feature.
BITS = 16
COST = 1.0
EPOCHS = 12
SMOOTHING = 1.0
SLOPE = 4.0
_D = 1 << BITS


def held_out(doc_id) -> F.Column:
    """Whether a document's label is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every indicator that is set; rows ascending."""
    n = len(offsets) - 1
    row_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    keys = []
    if len(data) >= 3:
        x = data.astype(np.uint32)
        grams = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - BITS)
        inside = row_of_byte[:-2] == row_of_byte[2:]
        keys.append(row_of_byte[:-2][inside] * (2 * _D) + grams[inside])
    starts, ends, bounds = textkit.words(data, offsets)
    if len(starts):
        one = textkit.word_hashes(data, starts, ends, lower=True)
        row = np.repeat(np.arange(n), np.diff(bounds))
        keys.append(row * (2 * _D) + _D + (one >> np.uint64(64 - BITS)).astype(np.int64))
        if len(one) > 1:
            inside = row[:-1] == row[1:]
            two = textkit.mix(one[:-1] * np.uint64(3) + one[1:])[inside]
            keys.append(row[:-1][inside] * (2 * _D) + _D + (two >> np.uint64(64 - BITS)).astype(np.int64))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    keys = np.concatenate(keys)
    for low in range(0, n, 256):  # a table of flags for some rows at a time
        part = keys[(keys >= low * 2 * _D) & (keys < (low + 256) * 2 * _D)] if n > 256 else keys
        flags = np.zeros(min(256, n - low) * 2 * _D, bool)
        flags[part - low * 2 * _D] = True
        found.append(np.flatnonzero(flags) + low * 2 * _D)
    keys = np.concatenate(found)
    return keys // (2 * _D), keys % (2 * _D)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, label and its document's columns."""
    for batch, data, offsets in textkit.passes(batches, "text", 1 << 19):
        rows, columns = _indicators(data, offsets)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        columns = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(columns.astype(np.int32)))
        yield pa.record_batch([batch.column("place"), batch.column("label"), columns], ["place", "label", "columns"])


def descend(bounds: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + cost * sum(hinge loss), one dual variable at a time; the last weight is the intercept."""
    w = np.zeros(2 * _D + 1)
    alpha = np.zeros(len(y))
    norm = np.array([np.square(values[a:b], dtype=np.float64).sum() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) + 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            at = slice(bounds[i], bounds[i + 1])
            gradient = y[i] * (w[columns[at]] @ values[at] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[columns[at]] += step * values[at]
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one model row: ratios and weights, from rows in order of place, as long as FEATURES allows."""
    labels, lists, total = [], [], 0
    counts = np.full((2, 2 * _D), SMOOTHING)
    for batch in batches:
        for label, columns in zip(batch.column("label").to_pylist(), batch.column("columns"), strict=True):
            columns = np.asarray(columns.values).astype(np.int32)
            total += len(columns)
            if total > FEATURES and labels:
                break
            labels.append(int(label > 0))
            lists.append(columns)
            counts[labels[-1]][columns] += 1
    ratio = np.zeros(2 * _D)
    w = np.zeros(2 * _D + 1)
    if len(set(labels)) == 2:
        bad, good = counts
        ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        columns = np.concatenate(lists)
        lists.clear()
        values = ratio.astype(np.float32)[columns]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            values[a:b] /= max(float(np.sqrt(np.square(values[a:b], dtype=np.float64).sum())), 1e-12)
        w = descend(bounds, columns, values, np.where(np.array(labels) > 0, 1.0, -1.0))
    yield pa.record_batch([pa.array([ratio.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["ratio", "weights"])


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Ratios and weights learnt from at most MOST labelled documents that aren't held out."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
        .withColumn("place", F.xxhash64("doc_id"))
        .orderBy("place", "doc_id")
        .limit(MOST)
    )
    chosen = saved(chosen, "chosen")
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    known = known.groupBy("place", "doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("place", "label", "text")
    features = saved(known.mapInArrow(_features, "place long, label int, columns array<int>"), "features")
    model = features.repartition(1).sortWithinPartitions("place").mapInArrow(_fit, "ratio binary, weights binary").collect()
    if not model:
        return np.zeros(2 * _D), np.zeros(2 * _D + 1)
    return np.frombuffer(model[0]["ratio"]), np.frombuffer(model[0]["weights"])


def _scores(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with a score for each row."""
    ratio, weights = shared.value
    for batch, data, offsets in textkit.passes(batches, "text", 1 << 19):
        rows, columns = _indicators(data, offsets)
        values = ratio[columns].astype(np.float64)
        length = np.sqrt(np.bincount(rows, values**2, batch.num_rows))
        margin = np.bincount(rows, values * weights[columns], batch.num_rows) / np.maximum(length, 1e-12) + weights[-1]
        yield batch, 1.0 / (1.0 + np.exp(-SLOPE * margin))


def _broadcast(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]):
    return docs.sparkSession.sparkContext.broadcast(tuple(x.astype(np.float32) for x in model))


def _schema(docs: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)


def rated(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all by default) of docs with score: 0 to 1, higher where label 1 is likelier."""
    shared = _broadcast(docs, model)
    keep = [c for c in keep or docs.columns if c != "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scores(shared, batches):
            yield batch.select(keep).append_column("score", pa.array(scores))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, f"{_schema(docs, keep)}, score double")


def kept(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5) -> DataFrame:
    """The rows of docs that score least or more, as they are."""
    shared = _broadcast(docs, model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scores(shared, batches):
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(choose, _schema(docs, docs.columns))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fitted(docs, table(spark, sf_dir, "labels"))
    scores = rated(docs, model, ["doc_id"])
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

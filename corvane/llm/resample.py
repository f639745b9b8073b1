"""Importance resampling towards a target: documents whose features the target has more often are drawn more often.

Features are runs of 1 to `runs` consecutive words (lower-cased A-Z), hashed into buckets. A bucket's gain is 1000 times the log of
how much commoner it is in the target than in the corpus, floored; a document's weight is the floored mean of its features'
gains, taken from the array of gains; its score adds Gumbel noise that doc_id decides. The best share of the documents
with enough words is drawn.

Ranks need no global sort. Scores are whole numbers in a range that the formula bounds (gains by the logarithm of 64-bit counts, noise by
32 bits: below 150,000 values), so their exact histogram is small: counts summed from the highest score on say where each score's
ranks begin and at which score the draw ends. Within a score that survives, rows are numbered by doc_id; where one score has more than
SLICE rows, they are numbered slice by slice of doc_id, whose counts give the offsets once more. Texts are read twice (counts, then
weights); the second pass writes five numbers a document, which the histogram and the ranks are taken from.

Edge cases: a null or empty text has no features and weight 0; repeated rows each get a row, and ranks of their own if drawn; a null doc_id
counts as an empty one in the noise and stands after all numbers of its score; an empty corpus gives no rows; with an empty target
every gain measures the corpus alone; very long texts are a pass of their own, and words of more than LONG bytes are hashed one by
one; columns other than doc_id and text are ignored by ranked() and kept by resampled().
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import masked, saved, table

RUNS, BUCKETS, LEAST_WORDS, SHARE, SEED = 1, 10_000, 20, 10, 2024
#: Rows of one score that are numbered in one task.
SLICE = 2_000_000
#: Bytes of a word beyond which it is hashed by itself.
LONG = 48
PASS = 1 << 20

_FOLD = np.full(256, 0x20, np.uint8)  # bytes that separate words become spaces
for _low, _high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_low:_high] = np.arange(_low, _high)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(255)] ^ state >> np.uint32(8)


def crc_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The inner CRC-32 states after the bytes of each span, the spans side by side, a byte a round."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, size, out = starts[order], size[order], state[order]
    long = int(np.searchsorted(-size, -LONG, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    at, size, rest = at[long:], size[long:], out[long:]
    for k in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))  # spans of more than k bytes
        rest[:m] = _step(rest[:m], data[at[:m] + k])
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, offsets: np.ndarray, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature, and the words of each row."""
    data = _FOLD[data]
    starts, ends, bounds = textkit.words(data, offsets)
    words = np.diff(bounds)
    row = np.repeat(np.arange(len(words)), words)
    state = crc_after(np.full(len(starts), _ONES), data, starts, ends)
    rows, found = [row], [(state ^ _ONES) % np.uint32(buckets)]
    for n in range(2, runs + 1):
        state = crc_after(_step(state[:-1], 0x20), data, starts[n - 1 :], ends[n - 1 :])
        inside = row[: len(state)] == row[n - 1 :]
        rows.append(row[: len(state)][inside])
        found.append((state[inside] ^ _ONES) % np.uint32(buckets))
    return np.concatenate(rows), np.concatenate(found).astype(np.int64), words


def bucket_counts(texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table's texts fall into each bucket: a task sends one row a bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, data, offsets in textkit.passes(batches, "text", PASS):
            total += np.bincount(features(data, offsets, runs, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    s, t, d = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + d) / ((s + 1) * (t.sum() + d)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandths of a Gumbel variate that the id decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch, data, offsets in textkit.passes(batches, "text", PASS):
            row, bucket, words = features(data, offsets, runs, len(gain))
            n = np.bincount(row, minlength=batch.num_rows)
            total = np.zeros(batch.num_rows, np.int64)
            order = np.argsort(row, kind="stable") if runs > 1 else slice(None)
            filled = np.flatnonzero(n)
            if len(filled):
                total[filled] = np.add.reduceat(gain[bucket[order]], (np.cumsum(n) - n)[filled])
            yield pa.record_batch([batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """rows with their place (1, 2, ...) by doc_id within their score; most: the rows of the commonest score."""
    order = F.asc_nulls_last("doc_id")
    if most <= SLICE:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy("score").orderBy(order)).cast("long"))
    n = -(-most // SLICE)
    edges = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(edges))).otherwise(sum(((F.col("doc_id") >= e).cast("int") for e in edges), F.lit(0)))
    rows = rows.withColumn("_slice", part)
    counts = rows.groupBy("score", "_slice").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("score").orderBy("_slice")) - F.col("_n")
    rows = rows.join(counts.select("score", "_slice", earlier.alias("_before")), ["score", "_slice"])
    within = F.row_number().over(Window.partitionBy("score", "_slice").orderBy(order))
    return rows.withColumn("place", F.col("_before") + within).drop("_slice", "_before")


def ranked(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every row of docs; share: percent of those with `least` words."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = saved(weighed(docs, gain, runs, seed), "scored")
    able = F.col("n_words") >= least
    histogram = {row["score"]: row["n"] for row in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    quota = share * sum(histogram.values()) // 100
    values = np.array(sorted(histogram, reverse=True), np.int64)
    counts = np.array([histogram[v] for v in values.tolist()], np.int64)
    before = np.cumsum(counts) - counts
    into = before < quota  # scores that the draw reaches
    names = ["doc_id", "n_features", "weight", "score"]
    if not into.any():
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    cutoff = int(values[into][-1])
    offsets = docs.sparkSession.createDataFrame(list(zip(values[into].tolist(), before[into].tolist(), strict=True)), "score long, before long")
    places = _numbered(scored.where(able & (F.col("score") >= cutoff)).select(*names), int(counts[into].max()))
    place = F.col("before") + F.col("place")
    drawn = places.join(F.broadcast(offsets), "score").select(*names, F.when(place <= quota, place).alias("rank"))
    return drawn.unionByName(scored.where(~(able & (F.col("score") >= cutoff))).select(*names, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, **options) -> DataFrame:
    """The rows of docs that are drawn, as they are; rows of one doc_id stay together if one of them is drawn."""
    chosen = saved(ranked(docs, target, share, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("_id")).distinct(), "drawn")
    given, names = masked(docs, "doc_id")
    return given.join(chosen, given["doc_id"].eqNullSafe(chosen["_id"]), "left_semi").select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op11_resample(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: The CRC is taken byte by byte of each different word, with a table that the polynomial's rule gives.
OP11_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
marks AS (SELECT {_WORDS} AS w FROM benchmark),
kinds AS (SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM docs UNION ALL SELECT unnest(w) FROM marks)),
octets AS (SELECT word, list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)) AS o FROM (SELECT word, hex(encode(word)) AS h FROM kinds)),
hashed AS (
  SELECT word, xor(list_reduce([4294967295] || o, lambda c, x: xor(t[CAST(xor(c, x) % 256 AS BIGINT) + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM octets, crc),
words AS (SELECT doc_id, unnest(w) AS word FROM docs),
s AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS word FROM marks) JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS tt),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (ss + 10000) / ((s::DOUBLE + 1) * (tt + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), sums),
means AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, sum(gain) AS total FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(CAST((total - ((total % n) + n) % n) // n AS BIGINT), 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM docs d LEFT JOIN means USING (doc_id)),
final AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM final WHERE n_features >= 20)
SELECT f.doc_id, n_features, weight, score, CASE WHEN place <= (10 * n) // 100 THEN CAST(place AS BIGINT) END AS rank
FROM final f LEFT JOIN placed USING (doc_id)
"""

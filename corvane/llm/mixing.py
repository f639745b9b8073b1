"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the total of all sizes; a target stops
at CAP times its source's size, and the excess goes to the others by weight (water filling, in closed form over the
sources sorted by cap / weight). Within a source every document expects target / source_size copies. The documents
are laid on a line in order of size, and a document is emitted once per integer boundary that its stretch, shifted
by one random offset per source, crosses. The order by size makes the taken words follow the target closely.

The prefix sum never puts a source into one task: offsets of sizes within a source, of 4096 hash cells within a
size, and a rank within a cell are three small windows, so a source with a third of all rows is dealt over many tasks.

Edge cases: null text has size 0; an empty table gives no rows; a null source is a source of its own, the last one;
a source without words has target 0 and takes nothing; very long texts are counted whole; repeated rows, of one doc_id or of none, are
separate documents, each with its own number of copies; more columns are ignored by mixed() and kept by sampled(), whatever
their names. Sources are numbered in one task: a row each of what is one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.shared import WORD, masked, saved, table

CAP = 3
WEIGHTS = 3
SEED = "mix"


def sizes(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words), the hash cell and the columns more of every document."""
    return docs.select(
        F.col("doc_id"),
        *more,
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 3).alias("cell"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, expected copies of each document, the random offset."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = by_source.select(
        "*",
        ((F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % WEIGHTS + 1).cast("long").alias("weight"),
        (F.col("source_size") * CAP).alias("most"),
    )
    rank = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    filled = weighed.select(
        "*",
        F.row_number().over(rank).alias("place"),
        (F.sum("source_size").over(everything) - F.sum("most").over(rank.rowsBetween(Window.unboundedPreceding, 0)) + F.col("most")).alias("left"),
        F.sum("weight").over(rank.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    free = F.col("left") * F.col("weight") <= F.col("most") * F.col("open")
    levelled = filled.select(
        "*",
        F.min(F.when(free, F.col("place"))).over(everything).alias("first"),
        F.min_by(F.col("left") / F.col("open"), F.when(free, F.col("place"))).over(everything).alias("level"),
    )
    target = F.when(F.col("place") < F.col("first"), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.col("level")))
    digest = F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.col("source"), F.lit("null"))).cast("binary"))
    return levelled.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("expected"),
        (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)).alias("offset"),
    )


def mixed(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns more, size, source_size, target, copies, taken for every row of docs."""
    sized = saved(sizes(docs, more), "sizes")
    by_cell = saved(sized.groupBy("source", "size", "cell").agg(F.count("*").alias("n")), "cells")
    by_size = by_cell.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before_size = by_size.select("source", "size", (F.sum("n").over(Window.partitionBy("source").orderBy("size")) - F.col("n")).alias("before_size"))
    before_cell = by_cell.select("source", "size", "cell", (F.sum("n").over(Window.partitionBy("source", "size").orderBy("cell")) - F.col("n")).alias("before_cell"))

    def on(a: DataFrame, b: DataFrame, *names: str) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns])
        match = a[names[0]].eqNullSafe(b[f"_{names[0]}"])
        for c in names[1:]:
            match = match & (a[c] == b[f"_{c}"])
        return a.join(b, match).drop(*[f"_{c}" for c in names])

    cells = on(on(before_cell, before_size, "source", "size"), targets(by_size.select("source", (F.col("size") * F.col("n")).alias("size"))), "source")
    place = F.col("before_size") + F.col("before_cell") + F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("doc_id"))
    e, u = F.col("expected"), F.col("offset")
    placed = on(sized, cells, "source", "size", "cell").withColumn("place", place)
    copies = F.floor(F.col("place") * e + u) - F.floor((F.col("place") - 1) * e + u)
    return placed.select("doc_id", *more, "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of the mix: every row of docs as often as it is taken.

    A row is told from others by doc_id and a hash of all its values. Rows that are the same in both are exchangeable: one of them
    stands for all, as often as they are taken together.
    """
    given, names = masked(docs, "doc_id", "text", "source")
    given = given.withColumn("_row", F.xxhash64(*given.columns))
    times = mixed(given, ("_row",)).groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"))
    times = saved(times.agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_same")).where("_copies > 0"), "times")
    taken = given.join(times, given["doc_id"].eqNullSafe(times["_id"]) & (given["_row"] == times["_hash"]))
    once = taken.where("_same = 1").union(taken.where("_same > 1").dropDuplicates(["_id", "_row"]))
    return once.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS cell
  FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM by_source),
filled AS (
  SELECT *, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - sum(most) OVER (o ROWS UNBOUNDED PRECEDING) + most AS BIGINT) AS "left",
         CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM weighed WINDOW o AS (ORDER BY most / weight, source NULLS LAST)),
first AS (SELECT place AS first, CAST("left" AS DOUBLE) / CAST(open AS DOUBLE) AS level FROM filled WHERE "left" * weight <= most * open ORDER BY place LIMIT 1),
sources AS (
  SELECT source, source_size, CASE WHEN place < first THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), weight * level) END AS target,
         CAST('0x' || substr(md5('mix|' || coalesce(source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM filled, first),
placed AS (
  SELECT doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
         row_number() OVER (PARTITION BY s.source ORDER BY size, cell, doc_id) AS place
  FROM sized s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(floor(place * e + u) - floor((place - 1) * e + u) AS BIGINT) AS copies,
       CAST((floor(place * e + u) - floor((place - 1) * e + u)) * size AS BIGINT) AS taken
FROM placed
"""

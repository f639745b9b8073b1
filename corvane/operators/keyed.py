"""Joins on keys of which a few may be very common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key on the long side from which it is dealt over several parts.
MOST = 200_000


def dealt_join(short: DataFrame, long: DataFrame, key: str, spread: Column, most: int = MOST, wide: bool = False) -> DataFrame:
    """The inner join of two tables on a key, its common values dealt out: rows of long by spread, those of short to every part.

    The list of common keys has one row for each `most` rows of long at most, so it may be broadcast; it is counted beforehand,
    by a partial aggregate. No part of a key has many more than `most` rows of long.

    wide: the result is far larger than both tables, so all shuffle partitions are kept, however few bytes are in them.
    """
    common = long.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    common = F.broadcast(common.select(F.col(key).alias("_common"), F.ceil(F.col("_n") / most).alias("_parts")))
    share = F.coalesce("_parts", F.lit(1)).cast("long")
    dealt = long.join(common, F.col(key) == F.col("_common"), "left").withColumn("_part", F.pmod(F.xxhash64(spread), share)).drop("_common", "_parts")
    every = short.join(common, F.col(key) == F.col("_common"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).drop("_common", "_parts")
    if wide:
        parts = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every, dealt = every.repartition(parts, key, "_part"), dealt.repartition(parts, key, "_part")
    return every.join(dealt, [key, "_part"]).drop("_part")


def pieces(text: Column, size: int | Column) -> Column:
    """All stretches of so many letters, one or more, of a string."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.expr("array_repeat('', 0)"))


def numbered_grams(text: Column, size: int) -> Column:
    """The stretches of a string whose ends and blanks are '_', each with the number of its occurrence: a set stands for the bag."""
    ends = F.repeat(F.lit("_"), F.lit(size - 1))
    bag = F.array_sort(pieces(F.concat(ends, F.translate(text, " ", "_"), ends), size))
    return F.transform(F.array(bag), lambda g: F.transform(g, lambda x, i: F.concat(x, (i + 1 - F.array_position(g, x)).cast("string"))))[0]

"""Centroids that are kept up to date: sums and counts by group and position, changed by what a batch adds and takes away.

A state has a row (group_id, position, total, n) for each dimension of each group. Merging a batch costs one shuffle of the state and of the
batch's sums; items that didn't change are not read. Totals are sums of whole numbers (entries times SCALE, rounded), so that adding
and taking away leaves no rounding behind, whatever the order of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of an entry in a total.
SCALE = 1 << 40


def sums(items: DataFrame, sign: int = 1) -> DataFrame:
    """The state of some items (group_id, vector), or with a sign of -1 what taking them away changes."""
    entries = items.where("vector IS NOT NULL").select("group_id", F.posexplode("vector").alias("position", "value"))
    whole = F.round(F.col("value").cast("double") * SCALE).cast("decimal(38,0)")
    return entries.groupBy("group_id", "position").agg((F.sum(whole) * sign).cast("decimal(38,0)").alias("total"), (F.count("*") * sign).alias("n"))


def changed(state: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The state after a batch; an item that changes is removed as it was and added as it is. Groups without items are gone."""
    rows = state.unionByName(sums(added)).unionByName(sums(removed, -1))
    return rows.groupBy("group_id", "position").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).where("n > 0")


def upserted(state: DataFrame, stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The state after items (item_id, group_id, vector) were put in the place of stored ones of their ids, or beside them."""
    old = stored.join(incoming.select("item_id").distinct(), "item_id", "left_semi")
    return changed(state, incoming, old)


def centroids(state: DataFrame) -> DataFrame:
    """(group_id, n, centroid) of a state."""
    value = (F.col("total").cast("double") / SCALE / F.col("n")).alias("value")
    rows = state.select("group_id", "position", "n", value)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x["value"])
    return rows.groupBy("group_id").agg(F.max("n").alias("n"), listed.alias("centroid"))

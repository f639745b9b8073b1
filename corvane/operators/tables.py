"""Table upkeep as DataFrame functions: upserts, pruning, pending rows, counts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.rounds import saved


def content_key(*parts: Column) -> Column:
    """The first 24 hexadecimal digits of the parts' sha1; null counts as empty."""
    return F.left(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), F.lit(24))


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merged(stored: DataFrame, incoming: DataFrame, key: list[str], policy: dict[str, str]) -> DataFrame:
    """stored with incoming merged into it by key (each key once on either side).

    policy, by column: "set" takes the incoming value, "set_if_given" only one that isn't null, "set_if_text" only one that isn't
    empty either, "fill" only where nothing is stored, "fill_text" also where the stored text is empty; rows on one side only stay as they are. One shuffle of both sides on the key.
    """
    a, b = stored.alias("a"), incoming.alias("b")
    match = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    there = F.col("b._there").isNotNull()
    both = a.join(incoming.withColumn("_there", F.lit(True)).alias("b"), match, "full_outer")
    rules = {
        "set": lambda c: F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")),
        "set_if_given": lambda c: F.coalesce(f"b.{c}", f"a.{c}"),
        "set_if_text": lambda c: F.coalesce(F.when(F.col(f"b.{c}") != "", F.col(f"b.{c}")), F.col(f"a.{c}")),
        "fill_text": lambda c: F.coalesce(F.when(F.col(f"a.{c}") != "", F.col(f"a.{c}")), F.col(f"b.{c}"), F.col(f"a.{c}")),
        "fill": lambda c: F.coalesce(f"a.{c}", f"b.{c}"),
    }
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[rules[rule](c).alias(c) for c, rule in policy.items()])


def pruned(stored: DataFrame, live: DataFrame, key: list[str], of_source: Column) -> DataFrame:
    """stored without the rows of a source that aren't live any more; refuses an empty live set."""
    if live.isEmpty():
        raise ValueError("the live set is empty: nothing is pruned")
    return stored.where(~of_source).unionByName(stored.where(of_source).join(live.select(*key).distinct(), key, "left_semi"))


def pending(rows: DataFrame, vectors: DataFrame, key: str, text: Column, model: str, refresh: bool = False) -> DataFrame:
    """Rows with a text that this model hasn't embedded yet (all with a text on refresh)."""
    given = rows.where(text.isNotNull() & (text != ""))
    return given if refresh else given.join(vectors.where(F.col("model") == model).select(key), key, "left_anti")


def write_snapshot(df: DataFrame, folder: str, number: int) -> str:
    """Write df as a new snapshot beside the ones that readers may still use."""
    path = f"{folder}/snapshot={number:06d}"
    df.write.parquet(path)
    return path


def latest_per_key(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The newest row of each key; rows without a time come first, as the newest."""
    return keep_first(rows, [key], [F.desc_nulls_first(when)])


def page(rows: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def placed(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with their place (1, 2, ...) in one order of all of them, without a task that sees them all.

    Rows are dealt into ranges of the order and sorted there; a row's place is its place within its range plus the rows of the ranges
    before, of which only the counts are gathered. Rows that are equal in the order lie in one range, so let the order end with a key.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id counts from 0 within each partition, in its low 33 bits
    ids = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = saved(ids)
    part, within = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # a row a range: as many as parts
    offsets = F.broadcast(counts.select("_range", before.alias("_before")))
    return kept.withColumn("_range", part).join(offsets, "_range").withColumn("place", F.col("_before") + within + 1).drop("_id", "_range", "_before")


def after(rows: DataFrame, order: list[tuple[str, bool]], last: list, limit: int = 50) -> DataFrame:
    """The page behind a row: the next rows in order after one with the values last, whatever was inserted or deleted before it.

    order: columns (none of them null) and whether each falls; the last ones must tell rows apart. Nothing is skipped over, so a late page
    costs as much as the first, and the bound reaches the scan.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1 to 200")
    beyond, equal = F.lit(False), F.lit(True)
    for (name, falls), value in zip(order, last, strict=True):
        beyond = beyond | equal & ((F.col(name) < value) if falls else (F.col(name) > value))
        equal = equal & (F.col(name) == value)
    first, value = order[0], last[0]
    bound = (F.col(first[0]) <= value) if first[1] else (F.col(first[0]) >= value)
    return rows.where(bound & beyond).orderBy(*[F.desc(n) if falls else F.asc(n) for n, falls in order]).limit(limit)


def next_offset(loaded: Column, total: Column) -> Column:
    """Where the next part of a list starts: after the rows that are loaded; null when all are."""
    return F.when(loaded < total, loaded)


def clamped(page_number: Column, total: Column, size: int = 15) -> Column:
    """A page's number within 1 and the last page of total rows."""
    last = F.greatest(F.lit(1), F.ceil(total / size).cast("int"))
    return F.greatest(F.lit(1), F.least(page_number, last))

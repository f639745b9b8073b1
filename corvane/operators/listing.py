"""Lists with filters: a page, the total, and for each filter how many rows its other values would give, from one scan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.rounds import saved


class Listing(NamedTuple):
    """page: rows with their place; counts: (facet, value, n), where facet is null for the total."""

    page: DataFrame
    counts: DataFrame


def listed(rows: DataFrame, filters: dict[str, tuple[Column, Column]], order: list[Column], limit: int = 50, offset: int = 0, always: Column | None = None) -> Listing:
    """The rows that pass all filters, in order, and counts of what each filter could be set to.

    filters: by name, a condition and the value that is counted (an array: each of its values once). A value's count is that of the rows that
    pass all other filters. always: a condition, such as a search, that counts nowhere as a filter. A row that fails two filters counts nowhere,
    so only the rest is written down, once; page and counts are taken from that. order must tell rows apart.
    """
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset not negative")
    names = list(filters)
    given = rows if always is None else rows.where(always)
    failed = F.filter(F.array(*[F.when(~F.coalesce(filters[n][0], F.lit(False)), F.lit(n)) for n in names]), lambda x: x.isNotNull()) if names else F.expr("array_repeat('', 0)")
    values = {n: v if isinstance(v, Column) else F.col(v) for n, (_, v) in filters.items()}
    near = saved(given.select("*", failed.alias("_failed"), *[values[n].alias(f"_value_{n}") for n in names]).where(F.size("_failed") <= 1))
    none = F.size("_failed") == 0
    kinds = dict(near.dtypes)
    each = lambda n: F.array_distinct(f"_value_{n}").cast("array<string>") if kinds[f"_value_{n}"].startswith("array") else F.array(F.col(f"_value_{n}").cast("string"))
    said_of = lambda n: lambda v: F.struct(F.lit(n).alias("facet"), v.alias("value"))
    pairs = [F.when(none | F.array_contains("_failed", n), F.transform(each(n), said_of(n))) for n in names]
    whole = F.when(none, F.array(F.struct(F.lit(None).cast("string").alias("facet"), F.lit(None).cast("string").alias("value"))))
    said = F.flatten(F.filter(F.array(whole, *pairs), lambda x: x.isNotNull()))
    counts = near.select(F.explode(said).alias("_said")).groupBy("_said.facet", "_said.value").agg(F.count("*").alias("n"))
    counts = counts.where("facet IS NULL OR value IS NOT NULL")
    best = near.where(none).orderBy(*order).limit(offset + limit)  # a bounded number of rows, put in their places
    place = F.row_number().over(Window.orderBy(*order))
    return Listing(best.withColumn("place", place).where(F.col("place") > offset).select(*rows.columns, "place"), counts)

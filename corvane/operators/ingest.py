"""Upserts of harvested rows: union of sources, resolved items, child rows, get-or-create, details; each as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.tables import keep_first, merged


def identities(sources: dict[str, DataFrame]) -> DataFrame:
    """(slug, full_name, unit, sources, one count a source) of the people of several sources, in the given order.

    Each source has family, given, unit (or null), slug and position. A person's names are those of the first row, the
    unit is the first that is known.
    """
    rows = None
    for k, (name, df) in enumerate(sources.items()):
        part = df.select("family", "given", "unit", "slug", F.lit(name).alias("source"), F.struct(F.lit(k).alias("k"), "position").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    first = F.min(F.struct("at", "family", "given")).alias("first")
    unit = F.min(F.when(F.col("unit").isNotNull(), F.struct("at", "unit"))).alias("unit")
    counts = [F.count_if(F.col("source") == name).alias(f"n_{name}") for name in sources]
    found = rows.groupBy("slug").agg(first, unit, F.array_sort(F.collect_set("source")).alias("sources"), *counts)
    return found.select("slug", F.concat_ws(", ", "first.family", "first.given").alias("full_name"), F.col("unit.unit").alias("unit"), "sources", *[f"n_{name}" for name in sources])


def resolved(items: DataFrame, people: DataFrame, key: list[str], order: Column) -> DataFrame:
    """items once a key (the first in order) with person_id by slug, and rejected: the reason why an item isn't stored, or null.

    items: the key, slug of the supervisor (or null); people: slug, person_id.
    """
    first = keep_first(items, key, [order])
    found = first.join(people.select("slug", "person_id"), "slug", "left")
    reason = F.when(F.col("slug").isNull(), "no supervisor").when(F.col("person_id").isNull(), "unresolved supervisor")
    return found.withColumn("rejected", reason)


def replaced_children(stored: DataFrame, incoming: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """The child rows after an upsert of parents: theirs come from incoming alone, all other parents keep what is stored."""
    kept = stored.join(parents.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(incoming.join(parents.select(parent).distinct(), parent, "left_semi"))


def programmes(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get or create by code: level and area are overwritten, the name only by one that holds something."""
    return merged(stored, incoming, ["code"], {"level": "set", "area": "set", "name": "set_if_text"})


def courses(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get or create by code: name, credits and url are only filled where nothing is stored."""
    return merged(stored, incoming, ["code"], {"name": "fill_text", "credits": "fill", "url": "fill_text"})


def offerings(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get or create by course, programme and semester (no semester is a value, too): the flags are overwritten."""
    return merged(stored, incoming, ["course_id", "programme_id", "semester"], {"is_elective": "set", "elective_group": "set"})


def detailed(stored: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses with what their detail pages say, and the details without a course (rejected).

    Names are overwritten by those that hold something, holder, outcomes and syllabus by whatever was read.
    """
    policy = {"name": "set_if_text", "name_en": "set_if_text", "holder": "set", "outcomes": "set", "syllabus": "set"}
    codes = stored.select("code")
    known = details.join(codes, "code", "left_semi")
    return merged(stored, known, ["code"], policy), details.join(codes, "code", "left_anti")

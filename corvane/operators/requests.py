"""Bounds of requests, checked as a table: which rows may be answered, with defaults, and what is wrong with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a request may hold.
TEXT_MOST, UNIT_MOST, FIELD_MOST, CODE_MOST, TOP_MOST = 500, 100, 200, 50, 50
KINDS = ("zavrsni", "diplomski")
GROUPS_TOP, ITEMS_TOP = 10, 12


def _too_long(name: str, most: int) -> Column:
    return F.when(F.length(name) > most, f"{name}: more than {most} characters")


def _checked(requests: DataFrame, top: int, *problems: Column) -> DataFrame:
    number = F.coalesce("top_k", F.lit(top))
    text = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "text: missing").when(F.length("text") > TEXT_MOST, f"text: more than {TEXT_MOST} characters")
    found = F.filter(F.array(text, F.when(~number.between(1, TOP_MOST), f"top_k: not 1 to {TOP_MOST}"), *problems), lambda x: x.isNotNull())
    return requests.withColumn("problems", found).withColumn("top_k", number)


def group_requests(requests: DataFrame) -> DataFrame:
    """requests (text, top_k, unit, field, kind) with problems, empty for one that may be answered; a null top_k is ten."""
    kind = F.when(~F.col("kind").isin(*KINDS), f"kind: not {' or '.join(KINDS)}")
    return _checked(requests, GROUPS_TOP, _too_long("unit", UNIT_MOST), _too_long("field", FIELD_MOST), kind)


def item_requests(requests: DataFrame) -> DataFrame:
    """requests (text, top_k, programme_code, programme_id) with problems; one of the programme's keys must be there; a null top_k is twelve."""
    none = F.when((F.coalesce("programme_code", F.lit("")) == "") & F.col("programme_id").isNull(), "programme: missing")
    return _checked(requests, ITEMS_TOP, _too_long("programme_code", CODE_MOST), none)


def answerable(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests without problems, and the others with theirs."""
    return checked.where(F.size("problems") == 0).drop("problems"), checked.where(F.size("problems") > 0)

"""Name search, identity and typo-tolerant queries: no SQL, as their edit distances have none; tests hold them to brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import identity, typo_search
from corvane.plans.standins import facts, table


def swapped(word: Column) -> Column:
    """A word with its second and third letters changed over."""
    return F.concat(F.left(word, F.lit(1)), F.substring(word, 3, 1), F.substring(word, 2, 1), F.substring(word, 4, 1000))


def fuzzy_people(spark, sf_dir: str) -> DataFrame:
    """Parts' two-word names as people, searched by the misspelt names of those whose id is divisible by 100: the first page of fifty."""
    words = F.split("p_name", " ")
    people = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("person_id"), words[0].alias("given"), words[1].alias("family"), F.col("p_size").alias("n_items"), "p_name")
    queries = people.where("person_id % 100 = 0").select(F.col("person_id").alias("query_id"), swapped(F.col("p_name")).alias("text"))
    return identity.search_people(people, queries, most=50)


def identity_merge(spark, sf_dir: str) -> DataFrame:
    """Parts' names and types in order of their number, merged where they are nearly equal."""
    slugs = table(spark, sf_dir, "part").select(F.concat(F.translate("p_name", " ", "_"), F.lit("_"), F.lower("p_type")).alias("slug"), F.col("p_partkey").alias("position"))
    return identity.canonical(slugs)


def typo_queries(rows: DataFrame) -> DataFrame:
    """Of items whose id is divisible by 100: a long word of the title with two letters changed over, and the beginning of another."""
    long = F.filter(F.split("title", " "), lambda w: F.length(w) >= 6)
    said = F.concat_ws(" ", swapped(F.get(long, F.lit(0))), F.left(F.get(long, F.lit(1)), F.lit(4)))
    return rows.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "group_id", said.alias("text"))


def typo_filter(spark, sf_dir: str) -> DataFrame:
    """The items of each query's group that hold its tokens up to typing errors, newest first, in pages of fifteen."""
    rows = facts(table(spark, sf_dir, "documents")).select("item_id", "group_id", "title", "year")
    found = typo_search.matches(rows, typo_queries(rows), text="title", group="group_id").join(rows.select("item_id", "year"), "item_id")
    return typo_search.paged(found, [F.desc_nulls_first("year"), F.col("item_id")]).select("query_id", "item_id", "place", "page", "pages")


QUERIES = {f.__name__: f for f in (fuzzy_people, identity_merge, typo_filter)}
SQL: dict[str, str] = {}

"""Name search and identity merging: pairs that share letters are found by joins, and only those are compared."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from corvane.functions import fuzzy
from corvane.functions import text as T
from corvane.operators.keyed import dealt_join, numbered_grams, pieces
from corvane.operators.rounds import saved

NAME_THRESHOLD = 72.0
IDENTITY_THRESHOLD = 94.0
#: Letters of the pieces that slugs are compared by.
GRAM = 3


@pandas_udf(DoubleType())
def _resemblance(asked: pd.Series, one: pd.Series, other: pd.Series, least: pd.Series) -> pd.Series:
    """The better weighted ratio of a query with a name's two orders; pairs whose letters rule out the least one get 0."""
    able = fuzzy.may_reach(asked, one, least)
    return pd.Series([max(fuzzy.weighted_ratio(a, x), fuzzy.weighted_ratio(a, y)) if ok else 0.0 for a, x, y, ok in zip(asked, one, other, able, strict=True)])


def _shared_needed(la: Column, lb: Column, threshold: float) -> Column:
    """How many two-letter pieces (ends and blanks marked, whatever the order of words) two strings share at least if they match.

    An edit breaks at most two pieces of the string that loses a letter and one of the other's. Strings of like lengths reach t >= 72
    by a common word (two pieces) or with at most (1 - t / 100) of their letters in edits: of n letters in all, n / 2 + 1 - 1.5
    * 0.28 n = 0.08 n + 1 pieces are left, so two. Of unlike lengths the shorter one must resemble a stretch of the other by 80, in
    which n / 3 - 1 of its n letters' pieces are left, and never none (a stretch cut by an end shares the end's piece). Of
    very unlike lengths only a query inside a name matches: all its inner pieces are shared.
    """
    short, long = F.least(la, lb), F.greatest(la, lb)
    if threshold < NAME_THRESHOLD:
        return F.lit(1)
    inside = F.greatest(F.lit(1), la - 1)
    stretch = F.greatest(F.lit(1), F.ceil(short / 3 - 1 - 1e-9))
    return F.when(long < 1.5 * short, 2).when(long <= 8 * short, F.least(F.lit(2), stretch)).otherwise(inside)


def _alike(texts: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(asked, one, other): the pairs that share as many pieces as a match must."""
    gram = lambda c: F.explode(numbered_grams(F.col(c), 2)).alias("gram")
    left = texts.where("asked <> ''").select("asked", gram("asked"))
    right = names.select("one", "other", gram("one"))
    met = dealt_join(left, right, "gram", F.col("one")).groupBy("asked", "one", "other").agg(F.count("*").alias("shared"))
    pairs = met.where(F.col("shared") >= _shared_needed(F.length("asked"), F.length("one"), threshold))
    # a query of one letter shares no inner piece with the names that hold it
    letters = names.select("one", "other", F.explode(F.array_distinct(F.split("one", ""))).alias("asked"))
    single = dealt_join(texts.where(F.length("asked") == 1), letters, "asked", F.col("one")).select("asked", "one", "other")
    return pairs.select("asked", "one", "other").unionByName(single).distinct()


def _holding(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, one, other): the names that hold a query, by an equi-join of whole queries with the names' stretches of their lengths."""
    texts = texts.where("asked <> ''")
    # as many lengths as the longest query has letters, at most
    sizes = sorted(r["size"] for r in texts.select(F.length("asked").alias("size")).distinct().collect())
    wanted = F.array(*map(F.lit, sizes)) if sizes else F.expr("array_repeat(0, 0)")
    stretches = lambda c: F.flatten(F.transform(wanted, lambda n: pieces(F.col(c), n)))
    held = names.select("one", "other", F.explode(F.array_distinct(F.concat(stretches("one"), stretches("other")))).alias("asked"))
    return dealt_join(texts, held, "asked", F.col("one")).select("asked", "one", "other")


def search_people(people: DataFrame, queries: DataFrame, threshold: float = NAME_THRESHOLD, most: int | None = None) -> DataFrame:
    """(query_id, person_id, inside, score, place): the people whose name matches a query, best first; most: of each query, so many.

    people: person_id, given, family, n_items; queries: query_id, text. Names that hold the query stand before those that only
    resemble it in one of both orders. An empty query matches everyone; one without letters or digits is empty; a null one, too.

    Queries and names of equal folded text are one each. Pairs come from an equi-join on two-letter pieces and are counted: only those
    that share as many as a match must (see _shared_needed) are compared, and of those only the ones whose letters allow it go through the
    edit distance. A piece that very many names have is dealt over several tasks. There is no limit on queries or names.

    No score is more than 100, so a threshold beyond that asks only for the names that hold the query: they are joined on the whole query,
    without any other pair, and scores are computed only where they are read.
    """
    given, family = T.fold_name(F.coalesce("given", F.lit(""))), T.fold_name(F.coalesce("family", F.lit("")))
    forms = people.select("person_id", "n_items", F.btrim(F.concat_ws(" ", given, family)).alias("one"), F.btrim(F.concat_ws(" ", family, given)).alias("other"))
    forms = saved(forms)
    asked = queries.select("query_id", T.fold_name(F.coalesce("text", F.lit(""))).alias("asked"))
    names, texts = forms.select("one", "other").distinct(), asked.select("asked").distinct()
    only_inside = threshold > 100
    inside = F.contains(F.col("one"), F.col("asked")) | F.contains(F.col("other"), F.col("asked"))
    pairs = _holding(texts, names).withColumn("inside", F.lit(True)) if only_inside else _alike(texts, names, threshold).withColumn("inside", inside)
    scored = pairs.withColumn("score", _resemblance("asked", "one", "other", F.when(F.col("inside"), 0.0).otherwise(threshold)))
    scored = scored if only_inside else scored.where(F.col("inside") | (F.col("score") >= threshold))
    if not texts.where("asked = ''").isEmpty():
        scored = scored.unionByName(names.select(F.lit("").alias("asked"), "one", "other", F.lit(True).alias("inside"), F.lit(0.0).alias("score")))
    order = [F.desc("inside"), F.desc("score"), F.desc("n_items"), F.col("person_id")]
    place = F.row_number().over(Window.partitionBy("asked").orderBy(*order))
    kept = scored.join(forms, ["one", "other"]).withColumn("place", place)
    kept = (kept if most is None else kept.where(F.col("place") <= most)).join(asked, "asked")
    return kept.select("query_id", "person_id", "inside", F.round("score", 6).alias("score"), "place")


def _rarest(slugs: DataFrame, frequency: DataFrame, keep: Column) -> DataFrame:
    """slug, position, n and each of the slug's rarest pieces, as many as keep says."""
    exploded = slugs.select("*", F.explode(numbered_grams(F.col("slug"), GRAM)).alias("gram")).join(frequency, "gram")
    place = F.row_number().over(Window.partitionBy("slug").orderBy("times", "gram"))
    return exploded.withColumn("_place", place).where(F.col("_place") <= keep).drop("_place", "times")


def similar_slugs(slugs: DataFrame, threshold: float = IDENTITY_THRESHOLD) -> DataFrame:
    """(a, b, score): pairs of different slugs with an indel ratio of threshold or more, the earlier one first.

    slugs: slug, position. Two slugs of n letters in all that differ by at most share * n edits keep n / 2 + 2 - 2.5 * share * n of their
    three-letter pieces (an edit breaks three of one's and two of the other's). So, with the pieces in one order from the rarest on, they
    agree in one of the first m + 3 - (what they keep) of each one's m + 2; only those are joined, so a common piece matters only to slugs
    that have few rarer ones. A piece that very many slugs hold among their rarest is dealt over tasks. No pair is lost.
    """
    share = 1 - threshold / 100 + 1e-9
    if share > 0.2 + 1e-6:
        raise ValueError("slugs that resemble each other by less than 80 need not share a piece of three letters")
    rows = slugs.select("slug", "position", F.length("slug").alias("n"))
    frequency = saved(rows.select(F.explode(numbered_grams(F.col("slug"), GRAM)).alias("gram")).groupBy("gram").agg(F.count("*").alias("times")))
    least = F.col("n") + F.ceil(F.col("n") * (1 - share) / (1 + share))  # letters of the slug and its shortest partner
    kept = F.greatest(F.lit(1), F.ceil(least * (0.5 - 2.5 * share) + 2 - 1e-6))
    pieces = saved(_rarest(rows, frequency, F.col("n") + GRAM - kept))
    x = pieces.select(F.col("slug").alias("x"), F.col("position").alias("px"), F.col("n").alias("nx"), "gram")
    y = pieces.select(F.col("slug").alias("y"), F.col("position").alias("py"), F.col("n").alias("ny"), "gram")
    near = (F.struct("px", "x") < F.struct("py", "y")) & (F.abs(F.col("nx") - F.col("ny")) <= share * (F.col("nx") + F.col("ny")))
    met = dealt_join(x, y, "gram", F.col("y")).where(near).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    return met.withColumn("score", fuzzy.indel_ratio_udf("a", "b")).where(F.col("score") >= threshold)


def canonical(slugs: DataFrame, threshold: float = IDENTITY_THRESHOLD) -> DataFrame:
    """(slug, canonical) of every slug, in order of arrival.

    A slug joins the earlier canonical slug with the best score (the earlier one on ties), or becomes canonical itself. Merging isn't
    transitive: an alias never attracts others. Rounds decide all slugs whose earlier neighbours are decided, each as joins.
    """
    first = slugs.groupBy("slug").agg(F.min("position").alias("position"))
    pairs = saved(similar_slugs(first, threshold).join(first.select(F.col("slug").alias("a"), "position"), "a"))
    decided = saved(first.join(pairs.select(F.col("b").alias("slug")).distinct(), "slug", "left_anti").select("slug", F.col("slug").alias("canonical")))
    left = saved(first.join(decided, "slug", "left_anti").select("slug"))
    while not left.isEmpty():
        open_ = pairs.join(left.select(F.col("slug").alias("b")), "b").join(decided.select(F.col("slug").alias("a"), "canonical"), "a", "left")
        best = F.max_by("a", F.when(F.col("a") == F.col("canonical"), F.struct("score", (-F.col("position")).alias("early"))))
        ready = open_.groupBy(F.col("b").alias("slug")).agg(F.every(F.col("canonical").isNotNull()).alias("ready"), best.alias("best")).where("ready")
        new = saved(ready.select("slug", F.coalesce("best", "slug").alias("canonical")))
        decided = saved(decided.unionByName(new))
        left = saved(left.join(new, "slug", "left_anti"))
    return decided


def typo_filter(texts: DataFrame, column: Column, query: str) -> DataFrame:
    """Rows whose text holds every token of one query up to typing errors at the beginnings of words; typo_search answers many at once."""
    fold = T.fold_slug(column)
    return texts.where(fuzzy.tolerates_udf(T.fold_slug(F.lit(query)), F.btrim(F.regexp_replace(fold, r"[^\p{L}\p{N}]+", " "))))

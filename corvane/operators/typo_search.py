"""Search of texts by tokens that may hold typing errors, many queries at once, by joins.

A text matches a query if it holds every token: anywhere inside, or, within the token's budget of edits (a swap of neighbours is one), as a beginning of
a word. Tokens meet the different words of all texts, not the texts:

* a token inside a word: both are joined on the token's first letters (four at most), and checked;
* a token near a word's beginning: what is left of the token's first n letters after up to `budget` deletions meets what is left of the
  word's first n (n: one of HEADS). Each edit costs each side one deletion at most, and where they put in more letters than they take out, or the
  other way round, the difference pays for what n letters cut off or add, so no match is missed; what meets is checked by the edit distance.
  Beginnings that words have in common meet once.

Words lead to texts by their postings; common words' are dealt over tasks. Of a query, only the texts of its rarest token are candidates, for
which the others are looked up. Texts that are equal (of one group) and queries of equal tokens are one each, and are told apart
only in the result. Tokens are looked up only in the groups that ask for them.

Edge cases: null and empty texts hold nothing; a null query, or one without tokens, gives every item (of its group); a token of
signs only, or with signs in it, must stand in the text as it is, or be near a beginning of a word; repeated items are repeated in
the result; repeated query ids (of one group) are one query with the tokens of all its rows; a null group is nobody's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from corvane.functions import fuzzy
from corvane.functions import text as T
from corvane.operators.keyed import dealt_join, pieces
from corvane.operators.rounds import saved

#: How many letters of a token decide which beginnings of words it meets: the most of these that it has. The last is for a budget of two.
HEADS = (4, 6, 8)
#: Copies of a text, or of a query, that are together in a part of a join.
COPIES = 2_000
#: Rows of a page.
PAGE = 15


@pandas_udf(BooleanType())
def _near(token: pd.Series, word: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([fuzzy.prefix_distance(t, w) <= b for t, w, b in zip(token, word, budget, strict=True)])


def budget_of(token: Column) -> Column:
    """Edits that a token may be off by: none for short ones and numbers, two for long ones."""
    n = F.length(token)
    return F.when((n < 4) | F.regexp_like(token, F.lit("^[0-9]+$")), 0).when(n < 8, 1).otherwise(2)


def _without_one(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))))).otherwise(F.expr("array_repeat('', 0)"))


def remains(text: Column, budget: int) -> Column:
    """What is left of a string after up to so many deletions."""
    found = F.array(text)
    for _ in range(budget):
        found = F.transform(F.array(found), lambda left: F.array_distinct(F.concat(left, F.flatten(F.transform(left, _without_one)))))[0]
    return found


def _inside(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word): words that hold the token's longest run of letters and digits."""
    runs = F.array_sort(F.regexp_extract_all("token", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda a, b: F.length(b) - F.length(a))
    asked = tokens.withColumn("core", F.get(runs, F.lit(0))).where("core is not null").withColumn("key", F.left("core", F.lit(4)))
    # at most four sizes
    wanted = [r["size"] for r in asked.select(F.length("key").alias("size")).distinct().collect()]
    keys = vocabulary.select("word", F.explode(F.array_distinct(F.concat(*[pieces(F.col("word"), n) for n in wanted])) if wanted else F.expr("array_repeat('', 0)")).alias("key"))
    return dealt_join(asked, keys, "key", F.col("word")).where(F.contains("word", F.col("core"))).select("token", "word")


def _misspelt(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word): words that begin like the token but for its budget of edits."""
    n = F.length("token")
    size = F.when(n < HEADS[1], HEADS[0]).when(n < HEADS[2], HEADS[1]).otherwise(HEADS[2])
    asked = tokens.withColumn("budget", budget_of(F.col("token"))).where("budget > 0").select("token", "budget", F.struct(size.alias("size"), F.left("token", size).alias("start")).alias("head"))
    starts = vocabulary.select("word", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.left("word", F.lit(k)).alias("start")) for k in HEADS])).alias("head"))
    starts = starts.where(F.length("head.start") >= F.col("head.size") - F.when(F.col("head.size") < HEADS[2], 1).otherwise(2))

    def left(rows: DataFrame, name: str) -> DataFrame:
        # each row becomes up to 37, so they are spread before, whatever their few bytes
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.select("head").distinct().repartition(parts, "head")
        one, two = rows.where(F.col("head.size") < HEADS[2]), rows.where(F.col("head.size") == HEADS[2])
        made = [r.select(F.col("head").alias(name), F.explode(remains(F.col("head.start"), k)).alias("rest")) for k, r in ((1, one), (2, two))]
        return made[0].unionByName(made[1]).select(name, F.struct(F.col(f"{name}.size").alias("size"), "rest").alias("key"))

    # a key has no more beginnings than letters can be put into it, so none is very common
    met = left(asked, "head").join(left(starts, "start"), "key").select("head", "start").distinct()
    near = asked.join(met, "head").select("token", "budget", F.col("start").alias("head"))
    return dealt_join(near, starts, "head", F.col("word")).select("token", "word", "budget").where(_near("token", "word", "budget")).select("token", "word")


def _signs(tokens: DataFrame, kinds: DataFrame) -> DataFrame:
    """(token, kind): texts with tokens that hold no letter or digit, met by the token's first sign."""
    asked = tokens.where(~F.regexp_like("token", F.lit(r"[\p{L}\p{N}]"))).withColumn("key", F.left("token", F.lit(1)))
    signs = kinds.select("kind", "hay", F.explode(F.array_distinct(F.split(F.regexp_replace("hay", r"[\p{L}\p{N}\s]", ""), ""))).alias("key"))
    return dealt_join(asked, signs, "key", F.col("kind")).where(F.contains("hay", F.col("token"))).select("token", "kind")


def matches(items: DataFrame, queries: DataFrame, typos: bool = True, text: str = "text", key: str = "item_id", group: str | None = None) -> DataFrame:
    """(query_id, key): the items that match each query. group: a column of both tables; a query asks the items of its group only."""
    own = [group] if group else []
    in_group = F.col(group).isNotNull() if group else F.lit(True)
    named = lambda c: F.unhex(F.md5(F.concat(*[F.concat(F.col(g).cast("string"), F.lit("|")) for g in own], c).cast("binary")))
    here = lambda c: F.struct(*own, c) if own else F.col(c)
    rows = items.where(F.col(key).isNotNull() & in_group).select(F.col(key).alias("row"), *own, T.fold_slug(F.coalesce(F.col(text), F.lit(""))).alias("hay"))
    texts = saved(rows.select("row", *own, "hay", named(F.col("hay")).alias("kind")))
    kinds = texts.select("kind", *own, "hay").distinct()
    words = saved(kinds.select("kind", *own, F.explode(F.array_distinct(F.split("hay", r"[^\p{L}\p{N}]+"))).alias("word")).where("word <> ''"))
    vocabulary = saved(words.select("word").distinct())
    split = F.filter(F.split(T.fold_slug(F.coalesce("text", F.lit(""))), r"\s+"), lambda t: t != "")
    said = queries.where(in_group).select("query_id", *own, F.explode_outer(split).alias("token")).groupBy("query_id", *own).agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    asks = saved(said.select("query_id", *own, "tokens", named(F.array_join("tokens", " ")).alias("ask")))
    sets = asks.select("ask", *own, "tokens").distinct()
    asked = saved(sets.select("ask", *own, F.explode("tokens").alias("token")))
    tokens = asked.select("token").distinct()

    def located(found: DataFrame) -> DataFrame:
        """(token, kind) of (token, word), in the groups that ask for the token."""
        spelt = found.join(asked.select(*own, "token").distinct(), "token") if own else found
        return dealt_join(spelt.select("token", here("word").alias("at")), words.select("kind", here("word").alias("at")), "at", F.col("kind")).select("token", "kind")

    inside = saved(_inside(tokens, vocabulary))
    plain = F.regexp_like("token", F.lit(r"^[\p{L}\p{N}]+$"))
    checked = located(inside.where(~plain)).distinct().join(kinds.select("kind", "hay"), "kind").where(F.contains("hay", F.col("token"))).select("token", "kind")
    spelt = inside.where(plain)
    if typos:
        spelt = saved(spelt.unionByName(_misspelt(tokens, vocabulary)).distinct())
    hits = saved(located(spelt).unionByName(checked).unionByName(_signs(tokens, kinds)).distinct())
    if own:
        hits = saved(hits.join(kinds.select("kind", *own), "kind").select("kind", here("token").alias("token")))
    asked = asked.select("ask", here("token").alias("token"))
    counts = asked.join(hits.groupBy("token").agg(F.count("*").alias("n")), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ordered = saved(counts.withColumn("at", F.row_number().over(Window.partitionBy("ask").orderBy("n", "token"))))
    found = dealt_join(ordered.where("at = 1").select("ask", "token"), hits, "token", F.col("kind")).select("ask", "kind")
    others = ordered.where("at > 1").groupBy("ask").agg(F.collect_set("token").alias("others"))
    open_ = found.join(others, "ask", "left").select("ask", "kind", F.coalesce(F.size("others"), F.lit(0)).alias("need"), F.explode_outer("others").alias("token"))
    whole = open_.join(hits.withColumn("_hit", F.lit(1)), ["token", "kind"], "left").groupBy("ask", "kind").agg(F.max("need").alias("need"), F.count("_hit").alias("got")).where("got = need").select("ask", "kind")
    empty = sets.where(F.size("tokens") == 0).select("ask", *own)
    if own:
        whole = whole.unionByName(dealt_join(empty, kinds.select("kind", *own), group, F.col("kind")).select("ask", "kind"))
    elif (one := empty.first()) is not None:  # queries without tokens are one
        whole = whole.unionByName(kinds.select(F.lit(one["ask"]).alias("ask"), "kind"))
    answers = dealt_join(whole, asks.select("ask", "query_id"), "ask", F.col("query_id"), COPIES).select("kind", "query_id")
    return dealt_join(answers, texts.select("kind", "row"), "kind", F.col("row"), COPIES, wide=True).select("query_id", F.col("row").alias(key))


def paged(found: DataFrame, order: list[Column], size: int = PAGE) -> DataFrame:
    """found (query_id, ...) with each row's place within its query, its page, and the number of pages."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    totals = found.groupBy("query_id").agg(F.ceil(F.count("*") / size).cast("int").alias("pages"))
    return found.withColumn("place", place).withColumn("page", F.ceil(F.col("place") / size).cast("int")).join(totals, "query_id")

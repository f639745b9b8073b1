"""The lexical mode (no vectors) and display helpers over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import lexical
from corvane.plans.standins import FACTS, facts, table


def tokens(text: Column) -> Column:
    """Distinct lower-case words of three letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))


def _asked(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens(F.col("text")).alias("asked"))


def _briefly(asked: DataFrame) -> DataFrame:
    """The queries, those whose id is divisible by 7 without their tokens."""
    return asked.withColumn("asked", F.when(F.col("query_id") % 7 != 0, F.col("asked")).otherwise(F.expr("array_repeat('', 0)")))


def _hits(spark, sf_dir: str) -> DataFrame:
    """(query_id, item_id, n, hits, weighted): an inverted join on tokens; those of the title count one and a half."""
    docs = facts(table(spark, sf_dir, "documents")).select("item_id", tokens(F.col("title")).alias("strong"), tokens(F.col("body")).alias("words"))
    words = docs.select("item_id", "strong", F.explode("words").alias("word")).select("item_id", "word", F.array_contains("strong", F.col("word")).alias("strong"))
    asked = _asked(spark, sf_dir).select("query_id", F.size("asked").alias("n"), F.explode("asked").alias("word"))
    return asked.join(words, "word").groupBy("query_id", "item_id").agg(F.max("n").alias("n"), F.count("*").alias("hits"), F.sum(F.when(F.col("strong"), 1.5).otherwise(1.0)).alias("weighted"))


def _postings(spark, sf_dir: str, title: float, asked: DataFrame) -> lexical.Postings:
    """The words of all items that the queries ask for; title: what those of the title count, against 1 for the others."""
    docs = facts(table(spark, sf_dir, "documents")).select("item_id", tokens(F.col("title")).alias("strong"), tokens(F.col("body")).alias("words"))
    rows = docs.select("item_id", "strong", F.explode("words").alias("word"))
    return lexical.postings(rows.select("item_id", "word", F.when(F.array_contains("strong", F.col("word")), title).otherwise(1.0).alias("weight")), asked)


def lexical_items(spark, sf_dir: str) -> DataFrame:
    """The ten best items of each query by weighted coverage of its tokens, mapped into 0.45 to 0.95."""
    asked = _asked(spark, sf_dir)
    found = lexical.best_items(_postings(spark, sf_dir, 1.5, asked), asked, 10).join(asked.select("query_id", F.size("asked").alias("n")), "query_id")
    score = F.round(F.least(F.lit(0.95), 0.45 + 0.5 * (F.col("weighted") / (F.col("n") * 1.5))), 9)
    return found.select("query_id", "item_id", score.alias("score"), "place")


def lexical_courses(spark, sf_dir: str) -> DataFrame:
    """The twelve best items of each query by plain coverage, mapped into 0.4 to 0.96; all items have 0.55 for one without tokens.

    Every seventh query is asked without its tokens here, as the table's ones all have some.
    """
    asked = _briefly(_asked(spark, sf_dir))
    found = lexical.best_items(_postings(spark, sf_dir, 1.0, asked), asked, 12).join(asked.select("query_id", F.size("asked").alias("n")), "query_id")
    score = F.round(F.least(F.lit(0.96), 0.4 + 0.55 * (F.col("hits") / F.col("n"))), 9)
    items = facts(table(spark, sf_dir, "documents"))
    return lexical.filled(found.select("query_id", "item_id", score.alias("score")), asked, items, 12, F.when(F.size("asked") > 0, 0.4).otherwise(0.55)).select("query_id", "item_id", "score", "place")


def page_window(current: Column, total: Column) -> Column:
    """The page numbers that are shown, as text: the ends, the page and its neighbours; a gap of one page is filled, others are '-'."""
    kept = F.array_sort(F.array_distinct(F.filter(F.array(F.lit(1), total, current, current - 1, current + 1), lambda p: p.between(1, total))))

    def shown(pages: Column) -> Column:
        def item(p: Column, i: Column) -> Column:
            gap = p - F.when(i > 0, F.get(pages, i - 1)).otherwise(0)
            said = p.cast("string")
            return F.when(gap == 2, F.array((p - 1).cast("string"), said)).when(gap > 2, F.array(F.lit("-"), said)).otherwise(F.array(said))

        return F.flatten(F.transform(pages, item))

    return F.array_join(F.transform(F.array(kept), shown)[0], " ")


def page_windows(spark, sf_dir: str) -> DataFrame:
    total = (F.col("s_suppkey") % 12 + 1).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", page_window((F.col("s_suppkey") % total + 1).cast("int"), total).alias("shown"))


def course_sentences(spark, sf_dir: str) -> DataFrame:
    """The sentence that explains a course, with its credits and semester if they are known."""
    credits, semester = F.floor(F.col("p_retailprice") / 100) / 2, F.col("p_size") % 5
    said = F.regexp_replace(F.format_string("%.1f", credits), r"\.?0+$", "")
    parts = F.concat_ws(", ", F.when(credits > 0, F.concat(said, F.lit(" ECTS"))), F.when(semester > 0, F.concat(semester.cast("string"), F.lit(". semestar"))))
    suffix = F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise("")
    # The wording of the sentence.
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Predloženo jer se ishodi i sadržaj predmeta poklapaju s tvojim opisom interesa"), suffix, F.lit(".")).alias("sentence"))


def kind_labels(spark, sf_dir: str) -> DataFrame:
    kind = F.lower("kind")
    label = F.when(kind.contains("diplom"), "Diplomski rad").when(kind.contains("zavr"), "Završni rad").when(kind.contains("doktor"), "Doktorski rad").otherwise(F.initcap("kind"))
    return facts(table(spark, sf_dir, "documents")).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def sections(spark, sf_dir: str) -> DataFrame:
    """The headed sections of every page, parsed where they are read."""
    from corvane.sources import pages

    return pages.sections(table(spark, sf_dir, "pages"), "page_id")


QUERIES = {f.__name__: f for f in (lexical_items, lexical_courses, page_windows, course_sentences, kind_labels, sections)}

_TOKENS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) > 2))"
_HITS = f"""{FACTS},
asked AS (SELECT query_id, len(t) AS n, unnest(t) AS word FROM (SELECT item_id AS query_id, {_TOKENS("text")} AS t FROM benchmark)),
words AS (SELECT item_id, word, list_contains(strong, word) AS strong FROM (SELECT item_id, {_TOKENS("title")} AS strong, unnest({_TOKENS("body")}) AS word FROM facts)),
hits AS (SELECT query_id, item_id, max(n) AS n, count(*) AS hits, sum(CASE WHEN strong THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS weighted FROM asked JOIN words USING (word) GROUP BY ALL)"""


def _ranked(score: str, k: int) -> str:
    return f"WITH {_HITS} SELECT * FROM (SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS place FROM (SELECT query_id, item_id, round({score}, 9) AS score FROM hits)) WHERE place <= {k}"


SQL = {
    "lexical_items": _ranked("least(0.95::DOUBLE, 0.45::DOUBLE + 0.5::DOUBLE * (weighted / (n * 1.5::DOUBLE)))", 10),
    "lexical_courses": f"""WITH {_HITS}, q AS (SELECT item_id AS query_id, len({_TOKENS("text")}) AS n FROM benchmark),
ids AS (SELECT DISTINCT item_id FROM facts WHERE item_id IS NOT NULL),
scored AS (
  SELECT q.query_id, ids.item_id, round(CASE WHEN q.n = 0 OR q.query_id % 7 = 0 THEN 0.55 ELSE least(0.96::DOUBLE, 0.4::DOUBLE + 0.55::DOUBLE * (coalesce(h.hits, 0) / q.n)) END, 9) AS score
  FROM q CROSS JOIN ids LEFT JOIN hits h ON h.query_id = q.query_id AND h.item_id = ids.item_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS place FROM scored) WHERE place <= 12""",
    "page_windows": """WITH s AS (SELECT s_suppkey, s_suppkey % 12 + 1 AS total, s_suppkey % (s_suppkey % 12 + 1) + 1 AS current FROM supplier),
p AS (SELECT s_suppkey, list_sort(list_distinct(list_filter([1, total, current, current - 1, current + 1], lambda x: x BETWEEN 1 AND total))) AS k FROM s),
q AS (SELECT s_suppkey, unnest(k) AS x, unnest([0] || k[:len(k) - 1]) AS b FROM p)
SELECT s_suppkey, string_agg(CASE WHEN x - b = 2 THEN (x - 1) || ' ' WHEN x - b > 2 THEN '- ' ELSE '' END || x, ' ' ORDER BY x) AS shown FROM q GROUP BY s_suppkey""",
    "course_sentences": """SELECT p_partkey, 'Predloženo jer se ishodi i sadržaj predmeta poklapaju s tvojim opisom interesa' || CASE WHEN s <> '' THEN ' (' || s || ')' ELSE '' END || '.' AS sentence
FROM (SELECT p_partkey, concat_ws(', ', CASE WHEN floor(p_retailprice / 100) > 0 THEN regexp_replace(printf('%.1f', floor(p_retailprice / 100) / 2), '\\.?0+$', '') || ' ECTS' END, CASE WHEN p_size % 5 > 0 THEN (p_size % 5) || '. semestar' END) AS s FROM part)""",
    "kind_labels": f"WITH {FACTS} SELECT CASE kind WHEN 'zavrsni' THEN 'Završni rad' WHEN 'diplomski' THEN 'Diplomski rad' ELSE 'Doktorski rad' END AS label, count(*) AS n FROM facts GROUP BY ALL",
}

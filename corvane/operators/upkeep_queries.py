"""Upserts of harvested rows over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import centroid_state, course_ingest, ingest
from corvane.operators.rounds import folder
from corvane.operators.runs import RunLog
from corvane.plans.standins import table


def source_union(spark, sf_dir: str) -> DataFrame:
    """Suppliers, customers and clerks of orders as the people of three sources, one identity a key."""
    person = lambda rows, key, unit: rows.select(
        F.concat(F.lit("Family"), (F.col(key) % 900).cast("string")).alias("family"), F.concat(F.lit("Given"), (F.col(key) % 7).cast("string")).alias("given"), unit.alias("unit"), F.col(key).alias("position"),
    )
    sources = {
        "schedule": person(table(spark, sf_dir, "supplier"), "s_suppkey", F.when(F.col("s_nationkey") > 5, F.col("s_nationkey"))),
        "advisors": person(table(spark, sf_dir, "customer"), "c_custkey", F.when(F.col("c_nationkey") > 9, F.col("c_nationkey"))),
        "committee": person(table(spark, sf_dir, "orders"), "o_orderkey", F.lit(None).cast("int")),
    }
    found = ingest.identities({name: df.withColumn("slug", T.slug(F.col("family"), F.col("given"))) for name, df in sources.items()})
    return found.withColumn("sources", F.array_join("sources", ",")).withColumn("unit", F.coalesce("unit", F.lit(-1)))


def resolved_items(spark, sf_dir: str) -> DataFrame:
    """Documents by text, the first of each, with the supplier that their number names; others are rejected with the reason."""
    docs = table(spark, sf_dir, "documents")
    slug = F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("s"), F.col("doc_id") % 150))
    rows = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("ext_id"), "doc_id", slug.alias("slug"))
    people = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slug"), F.col("s_suppkey").alias("person_id"))
    return ingest.resolved(rows, people, ["ext_id"], F.col("doc_id")).select("ext_id", "doc_id", "person_id", "rejected")


def replaced_roles(spark, sf_dir: str) -> DataFrame:
    """Lines as the children of orders: every third order's are replaced by new ones, or by none."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("person_id"))
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = lines.where("l_linenumber <= 2 AND l_orderkey % 2 = 0").withColumn("person_id", F.col("person_id") + 1000)
    return ingest.replaced_children(lines, new, parents, "l_orderkey")


def upserted_programmes(spark, sf_dir: str) -> DataFrame:
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    stored = nations.where("n_nationkey < 15").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.lit("old").alias("level"), F.lit("a").alias("area"), F.col("n_name").alias("name"))
    joined = nations.where("n_nationkey >= 8").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    new = joined.select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("r_name").alias("level"), F.lit("b").alias("area"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise("").alias("name"))
    return ingest.programmes(stored, new)


def _courses(spark, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 4 == 0, F.lit(None)).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.col("p_name"))
    credits = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 2)
    return table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("code"), name.alias("name"), credits.alias("credits"), F.lit("").alias("url"))


def upserted_courses(spark, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "part").where("p_partkey % 7 < 5").select(F.col("p_partkey").alias("code"), F.upper("p_name").alias("name"), F.lit(6.0).alias("credits"), F.concat(F.lit("/predmet/"), "p_partkey").alias("url"))
    return ingest.courses(_courses(spark, sf_dir), new)


def upserted_offerings(spark, sf_dir: str) -> DataFrame:
    """Offerings by course, programme and semester, of which some have none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("course_id"), F.col("l_suppkey").alias("programme_id"), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")).alias("semester"), "l_returnflag", "l_orderkey")
    one = lambda rows: rows.groupBy("course_id", "programme_id", "semester").agg((F.max("l_returnflag") == "R").alias("is_elective"), F.max("l_returnflag").alias("elective_group"))
    found = ingest.offerings(one(lines.where("l_orderkey % 2 = 0")), one(lines.where("l_orderkey % 3 = 0")))
    return found.withColumn("semester", F.coalesce("semester", F.lit(-1)))


def _details(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    stored = _courses(spark, sf_dir).select("code", "name", none.alias("name_en"), F.lit("holder").alias("holder"), none.alias("outcomes"), none.alias("syllabus"))
    new = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(
        F.col("p_partkey").alias("code"), F.when(F.col("p_size") > 20, F.upper("p_name")).otherwise("").alias("name"), F.lower("p_type").alias("name_en"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("holder"), F.col("p_type").alias("outcomes"), F.lit("s").alias("syllabus"),
    )
    return ingest.detailed(stored, new)


def course_details(spark, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir)[0]


def course_details_rejected(spark, sf_dir: str) -> DataFrame:
    """Details of courses that the first pass hasn't met."""
    return _details(spark, sf_dir)[1].select("code", "name_en")


def centroids_kept(spark, sf_dir: str) -> DataFrame:
    """Centroids of vectors by their number: a start, then upserts of a part that changes groups and deletes of another part."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    start = vectors.where("item_id % 3 <> 0").withColumn("group_id", F.col("item_id") % 40)
    state = centroid_state.sums(start)
    moved = vectors.where("item_id % 4 = 0").withColumn("group_id", F.col("item_id") % 7)
    state = centroid_state.upserted(state, start, moved)
    gone = start.join(moved.select("item_id"), "item_id", "left_anti").where("item_id % 5 = 0")
    state = centroid_state.changed(state, start.limit(0), gone)
    return centroid_state.centroids(state).select("group_id", "n", F.size("centroid").alias("dimensions"), F.round(F.aggregate("centroid", F.lit(0.0), lambda x, y: x + y), 6).alias("total"), F.round(F.col("centroid")[0], 6).alias("first"))


def _course_pages(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Programmes' and courses' pages whose text comes from nations and parts."""
    parts = table(spark, sf_dir, "part").withColumn("nation", F.col("p_partkey") % 25).withColumn("elective", F.col("p_partkey") % 2 == 0)
    link = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit('<a href="/predmet/c'), "p_partkey", F.lit('?x=1">'), "p_name", F.lit("</a>"))).otherwise(F.col("p_name"))
    box = F.concat(F.lit('<div class="coursebox-content"><div class="leftcont">ECTS '), F.translate((F.col("p_size") / 2).cast("string"), ".", ","), F.lit("</div>"), link, F.lit("</div>"))
    boxes = lambda chosen: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct(F.col("p_partkey").alias("k"), box.alias("html"))))), lambda x: x["html"]), "")
    lists = parts.groupBy("nation").agg(boxes(~F.col("elective")).alias("must"), boxes(F.col("elective")).alias("may"))
    html = F.concat(F.lit('<a href="#s1" title="1. semestar">I</a><h1>'), F.initcap("n_name"), F.lit('</h1><div id="s1"><h4 class="grouptitle">Obvezni</h4>'), "must", F.lit('<h4 class="grouptitle">Izborni (2)</h4>'), "may", F.lit("</div>"))
    programmes = table(spark, sf_dir, "nation").join(lists, F.col("n_nationkey") == F.col("nation"), "left").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), F.lit("pred").alias("level"), F.col("n_regionkey").cast("string").alias("area"), html.alias("html"))
    page = F.concat(F.lit("<title> "), F.upper("p_name"), F.lit("</title><h3>Nositelj</h3><p>H "), "p_type", F.lit("</p><h3>Opis kolegija</h3><h3>Sadržaj</h3><p>"), "p_name", F.lit(" <b>x</b></p>"))
    details = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("c"), "p_partkey").alias("code"), page.alias("html"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<title>E "), "p_name", F.lit("</title>"))).alias("html_en"))
    return programmes, details


def _catalogue(spark, sf_dir: str) -> tuple[RunLog, course_ingest.Catalogue]:
    log = RunLog(spark, folder(spark))
    return log, course_ingest.ingest_courses(log, course_ingest.nothing(spark), *_course_pages(spark, sf_dir), with_en=True)


def ingested_courses(spark, sf_dir: str) -> DataFrame:
    """Courses after an audited ingest of pages made from the tables."""
    return _catalogue(spark, sf_dir)[1].courses.drop("outcomes")


def ingested_offerings(spark, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir)[1].offerings


def ingest_log(spark, sf_dir: str) -> DataFrame:
    """What the log says of that ingest."""
    return _catalogue(spark, sf_dir)[0].states().select("source", "status", "parsed", "upserted", "rejected", F.size("warnings").alias("n_warnings"), F.element_at("warnings", 1).alias("first_warning"))


QUERIES = {f.__name__: f for f in (
    source_union, resolved_items, replaced_roles, upserted_programmes, upserted_courses, upserted_offerings, course_details, course_details_rejected, centroids_kept,
    ingested_courses, ingested_offerings, ingest_log,
)}

_COURSES = """courses AS (
  SELECT p_partkey AS code, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 2 END AS credits FROM part WHERE p_partkey % 5 <> 0)"""
_DETAILS = """details AS (
  SELECT p_partkey AS code, CASE WHEN p_size > 20 THEN upper(p_name) ELSE '' END AS name, lower(p_type) AS name_en, CASE WHEN p_size > 10 THEN p_brand END AS holder, p_type AS outcomes
  FROM part WHERE p_partkey % 2 = 0)"""
SQL = {
    "source_union": """
WITH rows AS (
  SELECT 0 AS k, 'schedule' AS source, s_suppkey AS n, CASE WHEN s_nationkey > 5 THEN s_nationkey END AS unit FROM supplier
  UNION ALL SELECT 1, 'advisors', c_custkey, CASE WHEN c_nationkey > 9 THEN c_nationkey END FROM customer
  UNION ALL SELECT 2, 'committee', o_orderkey, NULL FROM orders),
named AS (SELECT *, 'Family' || (n % 900) AS family, 'Given' || (n % 7) AS given FROM rows)
SELECT lower(family) || '_' || lower(given) AS slug, any_value(family) || ', ' || any_value(given) AS full_name, coalesce(first(unit ORDER BY k, n) FILTER (unit IS NOT NULL), -1) AS unit,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (source = 'schedule') AS n_schedule, count(*) FILTER (source = 'advisors') AS n_advisors,
       count(*) FILTER (source = 'committee') AS n_committee
FROM named GROUP BY family, given""",
    "resolved_items": """
WITH first AS (SELECT md5(coalesce(text, '')) AS ext_id, min(doc_id) AS doc_id FROM documents GROUP BY md5(coalesce(text, '')))
SELECT ext_id, doc_id, s_suppkey AS person_id, CASE WHEN doc_id % 9 = 0 THEN 'no supervisor' WHEN s_suppkey IS NULL THEN 'unresolved supervisor' END AS rejected
FROM first LEFT JOIN supplier ON s_suppkey = doc_id % 150 AND doc_id % 9 <> 0""",
    "replaced_roles": """
WITH lines AS (SELECT l_orderkey, l_linenumber, l_suppkey AS person_id FROM lineitem), parents AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM lines WHERE l_orderkey NOT IN (SELECT o_orderkey FROM parents)
UNION ALL SELECT l_orderkey, l_linenumber, person_id + 1000 FROM lines WHERE l_linenumber <= 2 AND l_orderkey % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM parents)""",
    "upserted_programmes": """
SELECT 'N' || n_nationkey AS code, CASE WHEN n_nationkey >= 8 THEN r_name ELSE 'old' END AS level, CASE WHEN n_nationkey >= 8 THEN 'b' ELSE 'a' END AS area,
       CASE WHEN n_nationkey >= 8 AND n_nationkey % 2 = 0 THEN lower(n_name) WHEN n_nationkey < 15 THEN n_name END AS name
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "upserted_courses": f"""
WITH {_COURSES}, new AS (SELECT p_partkey AS code, upper(p_name) AS name, '/predmet/' || p_partkey AS url FROM part WHERE p_partkey % 7 < 5)
SELECT coalesce(a.code, b.code) AS code, coalesce(nullif(a.name, ''), b.name, a.name) AS name, coalesce(a.credits, CASE WHEN b.code IS NOT NULL THEN 6.0::DOUBLE END) AS credits,
       coalesce(b.url, '') AS url
FROM courses a FULL JOIN new b ON a.code = b.code""",
    "upserted_offerings": """
WITH lines AS (SELECT l_partkey AS course_id, l_suppkey AS programme_id, CASE WHEN l_linenumber < 6 THEN l_linenumber ELSE -1 END AS semester, l_returnflag, l_orderkey FROM lineitem),
old AS (SELECT course_id, programme_id, semester, max(l_returnflag) AS f FROM lines WHERE l_orderkey % 2 = 0 GROUP BY ALL),
new AS (SELECT course_id, programme_id, semester, max(l_returnflag) AS f FROM lines WHERE l_orderkey % 3 = 0 GROUP BY ALL)
SELECT course_id, programme_id, semester, coalesce(new.f, old.f) = 'R' AS is_elective, coalesce(new.f, old.f) AS elective_group FROM old FULL JOIN new USING (course_id, programme_id, semester)""",
    "course_details": f"""
WITH {_COURSES}, {_DETAILS}
SELECT a.code, coalesce(nullif(b.name, ''), a.name) AS name, b.name_en, CASE WHEN b.code IS NULL THEN 'holder' ELSE b.holder END AS holder, b.outcomes,
       CASE WHEN b.code IS NOT NULL THEN 's' END AS syllabus
FROM courses a LEFT JOIN details b ON a.code = b.code""",
    "course_details_rejected": f"WITH {_COURSES}, {_DETAILS} SELECT code, name_en FROM details WHERE code NOT IN (SELECT code FROM courses)",
    "centroids_kept": """
WITH items AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN vec_id % 7 ELSE vec_id % 40 END AS group_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 4 = 0 OR vec_id % 3 <> 0 AND vec_id % 5 <> 0),
entries AS (SELECT group_id, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM items),
means AS (SELECT group_id, i, avg(x) AS x, count(*) AS n FROM entries GROUP BY group_id, i)
SELECT group_id, max(n) AS n, CAST(count(*) AS INTEGER) AS dimensions, round(sum(x), 6) AS total, round(max(x) FILTER (i = 1), 6) AS first FROM means GROUP BY group_id""",
    "ingested_courses": """
SELECT 'c' || p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN 'E ' || p_name END AS name_en, p_size / 2 AS credits, '/predmet/c' || p_partkey AS url,
       CASE WHEN p_partkey % 3 = 0 THEN 'H ' || p_type END AS holder, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' x' END AS syllabus,
       CASE WHEN p_partkey % 3 = 0 THEN concat_ws(chr(10), upper(p_name), CASE WHEN p_partkey % 2 = 0 THEN 'E ' || p_name END, p_name || ' x') END AS embedding_text
FROM part WHERE p_partkey % 11 <> 0""",
    "ingested_offerings": """
SELECT 'c' || p_partkey AS course_id, 'N' || p_partkey % 25 AS programme_id, 1 AS semester, p_partkey % 2 = 0 AS is_elective, CASE WHEN p_partkey % 2 = 0 THEN 'Izborni' END AS elective_group
FROM part WHERE p_partkey % 11 <> 0""",
    "ingest_log": """
WITH n AS (SELECT count(*) FILTER (p_partkey % 11 <> 0) AS good, count(*) FILTER (p_partkey % 11 = 0) AS bad, count(*) FILTER (p_partkey % 11 <> 0 AND p_partkey % 3 = 0) AS described FROM part),
first AS (SELECT 'N' || p_partkey % 25 AS page, p_name, replace(CAST(p_size / 2 AS VARCHAR), '.', ',') AS credits FROM part WHERE p_partkey % 11 = 0)
SELECT 'courses' AS source, 'ok' AS status, good + described AS parsed, good + described AS upserted, bad AS rejected, CAST(least(bad, 201) AS INTEGER) AS n_warnings,
       (SELECT min('no link in ' || page || ': ECTS ' || credits || ' ' || p_name) FROM first) AS first_warning FROM n""",
}

"""Full recommendation rows, lists, details and display helpers over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import display as D
from corvane.functions import text as T
from corvane.operators import identity, lexical_queries, listing, ranking, ranking_queries, requests, tables
from corvane.plans import sql
from corvane.plans.standins import FACTS, ITEMS, PARAMS, SEARCHES, facts, items, searches, table

P = PARAMS
NOW = P.now_year
COURSE_ROWS = 120


def titles(spark, sf_dir: str) -> DataFrame:
    """Titles as lists and as details show them: the field stands in for the second language."""
    rows = facts(table(spark, sf_dir, "documents"))
    first, second = F.when(F.col("item_id") % 11 != 0, F.col("title")), F.col("field")
    return rows.select("item_id", F.md5(D.listed_title(first, second).cast("binary")).alias("listed"), F.md5(D.detail_title(first, second).cast("binary")).alias("shown"))


def programmes(spark, sf_dir: str) -> DataFrame:
    """Nations as programmes: id, level (the region), area, code and name."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    area = F.when(F.col("n_nationkey") % 4 != 0, F.left("n_name", F.lit(8)))
    return rows.select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("level"), area.alias("area"), F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))


def unit_items(spark, sf_dir: str) -> DataFrame:
    """Items whose person belongs to one of the first eight units: the join with people only filters."""
    people = table(spark, sf_dir, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("group_id"))
    return facts(table(spark, sf_dir, "documents")).join(people, "group_id", "left_semi").select("item_id", "group_id")


def _offerings(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("semester")).distinct()


def course_pool(spark, sf_dir: str) -> DataFrame:
    """The courses in the first rows of courses joined with semesters, each once again: best similarity, semesters, first semester."""
    found = ranking.joined_pool(searches(spark, sf_dir), items(spark, sf_dir), _offerings(spark, sf_dir), COURSE_ROWS)
    return found.select("query_id", "item_id", "similarity", F.array_join(F.transform("semesters", lambda x: x.cast("string")), ",").alias("semesters"), "semester")


def recommended_people(spark, sf_dir: str) -> DataFrame:
    """Recommendations as they are shown: name, unit, works, topics of this year, shared keywords and the sentence.

    Keywords are those of all hits of the person, in the order of the hits, each folded form once, six at most; if there are any, the
    sentence counts the works that have one, else all hits.
    """
    asked, stock = searches(spark, sf_dir), items(spark, sf_dir)
    best = ranking.recommend_groups(asked, stock, P)
    hits = ranking.hits(asked, stock, P)
    order = Window.partitionBy("query_id", "group_id").orderBy(F.desc("hybrid"), "place")
    ranked = hits.select("query_id", "group_id", "item_id", "title", "year", "keywords", "terms", F.row_number().over(order).alias("n"))
    ranked = ranked.join(best.select("query_id", "group_id"), ["query_id", "group_id"], "left_semi")
    words = ranked.select("query_id", "group_id", "n", "terms", F.posexplode("keywords").alias("at", "keyword"))
    met = words.where(F.exists(T.content_terms(F.col("keyword")), lambda b: F.exists("terms", lambda a: T.tokens_match(a, b))))
    with_one = met.groupBy("query_id", "group_id").agg(F.count_distinct("n").alias("n_shared"))
    said = met.select("query_id", "group_id", F.btrim("keyword").alias("keyword"), F.struct("n", "at").alias("order"))
    first = said.groupBy("query_id", "group_id", T.fold(F.col("keyword")).alias("folded")).agg(F.min(F.struct("order", "keyword")).alias("first"))
    six = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "group_id").orderBy("first"))).where("k <= 6")
    listed = six.groupBy("query_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "first"))), lambda x: x["first"]["keyword"]).alias("matched"))
    totals = ranked.groupBy("query_id", "group_id").agg(F.count("*").alias("n_hits"), F.min_by(F.struct("title", "year"), "n").alias("top"))
    works = facts(table(spark, sf_dir, "documents")).groupBy("group_id").agg(F.count("*").alias("n_works"))
    current = facts(table(spark, sf_dir, "documents")).where((F.col("source") == "schedule") & (F.btrim("title") != ""))
    first_ten = current.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("item_id"))).where("k <= 10")
    topics = first_ten.groupBy("group_id").agg(F.count("*").alias("n_topics"))
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("group_id"), F.col("s_name").alias("full_name"), F.col("s_nationkey").alias("unit"))
    rows = best.join(people, "group_id").join(totals, ["query_id", "group_id"]).join(listed, ["query_id", "group_id"], "left")
    rows = rows.join(with_one, ["query_id", "group_id"], "left").join(works, "group_id", "left").join(topics, "group_id", "left")
    matched = F.coalesce("matched", F.expr("array_repeat('', 0)"))
    sentence = D.person_sentence(F.col("full_name"), F.coalesce("n_shared", "n_hits"), D.listed_title(F.col("top.title")), F.col("top.year"), matched)
    return rows.select(
        "query_id", "place", "group_id", "full_name", "unit", F.round("score", 4).alias("score"), F.coalesce("n_works", F.lit(0)).alias("n_works"),
        F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.array_join(matched, "|").alias("matched"), sentence.alias("explanation"),
    )


def recommended_courses(spark, sf_dir: str) -> DataFrame:
    """Recommended courses as they are shown: first semester, the query's words that the course has, and the sentence."""
    stock, asked = items(spark, sf_dir), searches(spark, sf_dir)
    eligible = table(spark, sf_dir, "part").where("p_size % 2 = 1").select(F.col("p_partkey").alias("item_id"))
    best = ranking_queries.recommend_courses(spark, sf_dir).select("query_id", "place", "item_id", "score")
    semesters = _offerings(spark, sf_dir).join(eligible, "item_id", "left_semi").groupBy("item_id").agg(F.min("semester").alias("semester"))
    body = stock.join(best.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.explode(F.array(T.content_terms(F.col("body")))).alias("body_terms"))
    words = asked.select("query_id", F.explode(F.array(T.content_words(F.col("text")))).alias("words"))
    rows = best.join(body, "item_id").join(words, "query_id").join(semesters, "item_id", "left")
    near = F.filter("words", lambda w: F.exists("body_terms", lambda b: T.tokens_match(w["folded"], b)))
    found = rows.select("query_id", "place", "item_id", F.round("score", 4).alias("score"), "semester", F.slice(F.transform(near, lambda w: w["surface"]), 1, 6).alias("matched"))
    credits = F.when(F.col("item_id") % 3 != 0, (F.col("item_id") % 14) / 2)
    return found.select("query_id", "place", "item_id", "score", "semester", F.array_join("matched", "|").alias("matched"), D.course_sentence(credits, F.col("semester"), F.col("matched")).alias("explanation"))


def _people(spark, sf_dir: str) -> DataFrame:
    """Suppliers with the number of their items, published and current ones together."""
    rows = facts(table(spark, sf_dir, "documents"))
    counts = rows.groupBy(F.col("group_id").alias("s_suppkey")).agg(F.count_if(F.col("source") == "repo").alias("n_repo"), F.count_if(F.col("source") == "schedule").alias("n_current"))
    people = table(spark, sf_dir, "supplier").join(counts, "s_suppkey", "left")
    return people.withColumn("n_works", F.coalesce("n_repo", F.lit(0)) + F.coalesce("n_current", F.lit(0)))


def people_list(spark, sf_dir: str) -> DataFrame:
    """A page of the people of some units with an item of a field, most works first, then by name, and their total."""
    of_field = facts(table(spark, sf_dir, "documents")).where(F.col("field").ilike("%e%")).select(F.col("group_id").alias("s_suppkey"))
    chosen = _people(spark, sf_dir).where("s_nationkey BETWEEN 3 AND 20").join(of_field, "s_suppkey", "left_semi")
    total = chosen.agg(F.count_distinct("s_suppkey").alias("total"))
    order = [F.desc("n_works"), F.expr("s_name collate hr"), F.col("s_suppkey")]
    page = tables.page(chosen, order, 10, 5).select("s_suppkey", "s_name", "s_nationkey", "n_works")
    return page.join(F.broadcast(total))  # one row


def people_browse(spark, sf_dir: str) -> DataFrame:
    """The people whose name holds a query, by unit and field: a page of them, their total, and what the filters' other values would give."""
    fields = facts(table(spark, sf_dir, "documents")).where("field <> ''").groupBy(F.col("group_id").alias("s_suppkey")).agg(F.collect_set("field").alias("fields"))
    people = _people(spark, sf_dir).join(fields, "s_suppkey", "left")
    filters = {"unit": (F.col("s_nationkey").between(3, 20), F.col("s_nationkey")), "field": (F.exists("fields", lambda x: x.contains("e")), F.col("fields"))}
    search = F.contains(T.fold_name(F.col("s_name")), F.lit("supplier 0"))
    found = listing.listed(people, filters, [F.desc("n_works"), F.expr("s_name collate hr"), F.col("s_suppkey")], 10, 5, search)
    none = F.lit(None)
    page = found.page.select(F.lit("person").alias("kind"), none.cast("string").alias("value"), F.col("n_works").alias("n"), "s_suppkey", F.col("place").cast("long").alias("place"))
    return page.unionByName(found.counts.select(F.coalesce("facet", F.lit("total")).alias("kind"), "value", "n", none.cast("long").alias("s_suppkey"), none.cast("long").alias("place")))


def people_found(spark, sf_dir: str) -> DataFrame:
    """People whose name holds a query, twenty a query, in an explicit order that overrides that of the match."""
    people = _people(spark, sf_dir)
    names = people.select(F.col("s_suppkey").alias("person_id"), F.split("s_name", "#")[0].alias("given"), F.split("s_name", "#")[1].alias("family"), F.col("n_works").alias("n_items"), "s_name")
    queries = names.where("person_id % 100 = 0").select(F.col("person_id").alias("query_id"), F.concat(F.lit("SÚPPLIER "), F.substring("s_name", 10, 7)).alias("text"))
    found = identity.search_people(names, queries, threshold=101.0).join(names.select("person_id", "s_name", "n_items"), "person_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.expr("s_name collate hr"), F.col("person_id")))
    return found.withColumn("place", place).where("place <= 20").select("query_id", F.col("person_id").alias("s_suppkey"), "s_name", F.col("n_items").alias("n_works"), "place")


def person_fields(spark, sf_dir: str) -> DataFrame:
    """Each person's fields, distinct and sorted, and number of works."""
    fields = facts(table(spark, sf_dir, "documents")).where("field <> ''").groupBy(F.col("group_id").alias("s_suppkey")).agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    return _people(spark, sf_dir).join(fields, "s_suppkey", "left").select("s_suppkey", "s_name", "n_works", F.coalesce("fields", F.lit("")).alias("fields"))


def person_items(spark, sf_dir: str) -> DataFrame:
    """Each person's current items, as of this year, with the published ones: newest first, unknown years last."""
    rows = facts(table(spark, sf_dir, "documents"))
    title = D.detail_title(F.col("title")).alias("title")
    url = T.landing_url(F.lit("repo"), F.concat(F.lit("urn:"), "item_id"), "https://example.org/").alias("url")
    current = rows.where("source = 'schedule'").select("group_id", "item_id", title, F.lit(NOW).alias("year"), F.lit(None).cast("string").alias("url"), F.lit(0).alias("part"))
    published = rows.where("source = 'repo'").select("group_id", "item_id", title, "year", url, F.lit(1).alias("part"))
    order = Window.partitionBy("group_id").orderBy(F.desc(F.coalesce("year", F.lit(0))), "part", "item_id")
    both = current.unionByName(published).withColumn("place", F.row_number().over(order))
    return both.select("group_id", "place", "item_id", F.md5(F.col("title").cast("binary")).alias("title_md5"), "year", "url")


def person_detail(spark, sf_dir: str) -> DataFrame:
    """Each person in full, a row for each item: name, unit, number of works, fields; items newest first (unknown years first), with link and keywords.

    A person without items has one row. Rows stay flat, so that no person's items are gathered in one.
    """
    rows = facts(table(spark, sf_dir, "documents"))
    fields = rows.where("field <> ''").groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))
    url = T.landing_url(F.col("source"), F.concat(F.lit("urn:"), "item_id"), "https://example.org/")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc_nulls_first("year"), "item_id"))
    items_ = rows.select("group_id", place.alias("place"), "item_id", F.md5(D.detail_title(F.col("title")).cast("binary")).alias("title_md5"), "year", "kind", F.array_join("keywords", "|").alias("keywords"), url.alias("url"))
    people = _people(spark, sf_dir).select(F.col("s_suppkey").alias("group_id"), "s_name", F.col("s_nationkey").alias("unit"), "n_works").join(fields, "group_id", "left")
    return people.withColumn("fields", F.coalesce("fields", F.lit(""))).join(items_, "group_id", "left")


def checked_requests(spark, sf_dir: str) -> DataFrame:
    """Requests made from documents, with what is wrong with each."""
    i = F.col("doc_id")
    made = table(spark, sf_dir, "documents").select(
        "doc_id", F.left("text", i % 700).alias("text"), F.when(i % 9 != 0, (i % 60).cast("int")).alias("top_k"), F.repeat("lang", (i % 60).cast("int")).alias("unit"),
        F.repeat("source", (i % 30).cast("int")).alias("field"), F.get(F.array(F.lit("zavrsni"), F.lit("diplomski"), F.lit(None), F.lit("doktorski")), (i % 4).cast("int")).alias("kind"),
    )
    return requests.group_requests(made).select("doc_id", "top_k", F.array_join("problems", "; ").alias("problems"))


def compared_people(spark, sf_dir: str) -> DataFrame:
    """Up to four people side by side in the order asked for: buckets of kinds, last sane year, five topics, three pieces of evidence."""
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(k).cast("long") for k in (7, 3, 12, 5)])).alias("slot", "group_id"))
    rows = facts(table(spark, sf_dir, "documents")).join(F.broadcast(wanted), "group_id")
    kind = F.when(F.col("item_id") % 7 == 0, "Seminarski rad").otherwise(F.concat(F.initcap("kind"), F.lit(" rad")))
    published = rows.where("source = 'repo'").withColumn("bucket", D.kind_bucket(kind))
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in ("zavrsni", "diplomski", "doktorski", "ostalo")]
    years = F.max(F.when(F.col("year").between(1950, NOW + 1), F.col("year"))).alias("last_year")
    evidence = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("year", F.lit(0))).alias("y"), "item_id"))), 1, 3)
    found = published.groupBy("slot", "group_id").agg(*counts, years, F.array_join(F.transform(evidence, lambda x: x["item_id"].cast("string")), ",").alias("evidence"))
    first = rows.where((F.col("source") == "schedule") & (F.btrim("title") != "")).withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("item_id"))).where("k <= 5")
    topics = first.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("topics"))
    return found.join(topics, "group_id", "left").select("slot", "group_id", "zavrsni", "diplomski", "doktorski", "ostalo", "last_year", "evidence", F.coalesce("topics", F.lit("")).alias("topics"))


def course_detail(spark, sf_dir: str) -> DataFrame:
    """Each course with the distinct programmes that offer it."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    offered = lines.select("l_partkey", "l_suppkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", F.col("s_nationkey").alias("id")).distinct()
    named = offered.join(programmes(spark, sf_dir).select("id", F.concat_ws(":", "level", "code").alias("programme")), "id")
    listed = named.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("programme")), ",").alias("programmes"))
    parts = table(spark, sf_dir, "part")
    return parts.join(listed, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_name", F.coalesce("programmes", F.lit("")).alias("programmes"))


def elective_profiles(spark, sf_dir: str) -> DataFrame:
    """The programmes of one level that offer each course as an elective, sorted."""
    chosen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    level = programmes(spark, sf_dir).where("level = 'EUROPE'").select("id", "name")
    met = chosen.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(level, F.col("s_nationkey") == F.col("id"))
    return met.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("profiles"))


def resolved_programmes(spark, sf_dir: str) -> DataFrame:
    """The programme that each request names: the id counts before the code, and an unknown one gives nothing."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 5).alias("asked_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("N"), "c_nationkey")).alias("asked_code"))
    known = programmes(spark, sf_dir).select("id", "code", "name")
    by_id = asked.where("asked_id IS NOT NULL").join(known, F.col("asked_id") == F.col("id"))
    by_code = asked.where("asked_id IS NULL").join(known, F.col("asked_code") == F.col("code"))
    return by_id.unionByName(by_code).select("c_custkey", "name")


def areas(spark, sf_dir: str) -> DataFrame:
    """The programmes of a level by area, areas in the order in which they are first seen; of a level with few programmes, too."""
    rows = programmes(spark, sf_dir).select("level", F.coalesce("area", F.lit("—")).alias("area"), "id", "name")
    listed = rows.groupBy("level", "area").agg(F.min("id").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ",").alias("names"))
    return listed.select("level", "area", F.row_number().over(Window.partitionBy("level").orderBy("first")).alias("place"), "names")


def summary_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of programmes, courses, offerings, electives, and courses with a text."""
    lines = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("offerings"), F.count_if(F.col("l_returnflag") == "A").alias("electives"))
    courses = table(spark, sf_dir, "part").agg(F.count("*").alias("courses"), F.count_if(F.col("p_size") > 10).alias("with_text"))
    found = table(spark, sf_dir, "nation").agg(F.count("*").alias("programmes"))
    return found.join(F.broadcast(courses)).join(F.broadcast(lines))  # one row each


def freshness(spark, sf_dir: str) -> DataFrame:
    """The latest successful run of each source with its number of warnings, and the newest time of all."""
    runs = table(spark, sf_dir, "events").where("event_id % 4 <> 0")
    last = tables.latest_per_key(runs, "event_type", "ts")
    warnings = F.when(F.col("event_id") % 3 != 0, F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k:long>>"))
    rows = last.select("event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("finished"), F.coalesce(F.size(warnings), F.lit(0)).alias("n_warnings"))
    newest = last.agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("newest"))
    return rows.withColumn("n_warnings", F.greatest("n_warnings", F.lit(0))).join(F.broadcast(newest))  # one row


def json_values(spark, sf_dir: str) -> DataFrame:
    """A JSON field read, and written again."""
    read = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", read["k"].alias("k"), F.to_json(F.struct(read["k"].alias("k"), "event_type")).alias("written"))


def unit_counts(spark, sf_dir: str) -> DataFrame:
    """People of each unit, most first, then by code in the locale's order."""
    code = F.concat(F.lit("U"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0"))
    counts = table(spark, sf_dir, "supplier").groupBy(code.alias("unit")).agg(F.count("*").alias("n"))
    return counts.select("unit", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.expr("unit collate hr"))).alias("place"))


def shortlist(spark, sf_dir: str) -> DataFrame:
    """How many people and courses each user has saved, and both together."""
    kept = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n % 2 = 1")
    people = F.count_if(F.col("event_type").isin("click", "view"))
    return kept.groupBy("user_id").agg(people.alias("people"), (F.count("*") - people).alias("courses"), F.count("*").alias("total"))


def kind_buckets(spark, sf_dir: str) -> DataFrame:
    """Published items of each person in buckets of kinds, by what the kind's name holds."""
    rows = facts(table(spark, sf_dir, "documents")).where("source = 'repo'")
    kind = F.when(F.col("item_id") % 7 == 0, "Seminarski rad").when(F.col("item_id") % 7 == 1, F.lit(None)).when(F.col("kind") == "zavrsni", "ZAVRŠNI rad").otherwise(F.col("kind"))
    bucket = rows.select("group_id", D.kind_bucket(kind).alias("bucket"))
    return bucket.groupBy("group_id").agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("zavrsni", "diplomski", "doktorski", "ostalo")])


def peaks(spark, sf_dir: str) -> DataFrame:
    """The first of the years with most items of each person who has items of two years or more."""
    rows = facts(table(spark, sf_dir, "documents")).where(F.col("year").between(1950, NOW + 1))
    counts = rows.groupBy("group_id", "year").agg(F.count("*").alias("n"))
    found = counts.groupBy("group_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "year")).alias("top"), F.count("*").alias("years")).where("years > 1")
    return found.select("group_id", F.col("top.year").alias("peak"), (-F.col("top.n")).alias("n"))


def profile_slugs(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", D.profile_slug(F.left(F.coalesce("text", F.lit("")), F.lit(80))).alias("slug"))


def surname_keys(spark, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", D.surname_key(name).alias("key"), D.surname_key(F.split("p_name", " ")[0]).alias("single"))


def shares_and_dates(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", D.percent(F.col("o_totalprice") / 500000).alias("share"), D.long_date(F.col("o_orderdate")).alias("date"))


def prompts(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    plain, led = D.prompt(text, "passage", "bge-m3"), D.prompt(text, "query", "multilingual-e5-large")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("plain"), F.md5(led.cast("binary")).alias("led"))


def keyword_matches(spark, sf_dir: str) -> DataFrame:
    """The keywords of each document that a benchmark text (the one of its number) shares a term with."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("asked"), F.explode(F.array(T.content_terms(F.col("text")))).alias("terms"))
    rows = facts(table(spark, sf_dir, "documents")).select("item_id", "keywords", (F.col("item_id") % 40).alias("asked"))
    return rows.join(asked, "asked").select("item_id", F.array_join(T.matched_keywords(F.col("terms"), F.col("keywords")), "|").alias("matched"))


def lexical_people(spark, sf_dir: str) -> DataFrame:
    """The lexical mode's people: decayed sums over their best items of one kind, five at most, with the sentence."""
    rows = facts(table(spark, sf_dir, "documents")).where("kind = 'diplomski'").select("item_id", "group_id", "year", "title", "keywords", "field")
    scored = lexical_queries._hits(spark, sf_dir).select("query_id", "item_id", F.round(F.least(F.lit(0.95), 0.45 + 0.5 * (F.col("weighted") / (F.col("n") * 1.5))), 9).alias("similarity"))
    order = Window.partitionBy("query_id", "group_id").orderBy(F.desc("similarity"), "item_id")
    hits = scored.join(rows, "item_id").withColumn("n", F.row_number().over(order))
    bonus = 1 + F.greatest(F.lit(0), F.lit(5) - (F.lit(NOW) - F.coalesce("year", F.lit(0)))) * 0.02
    term = F.col("similarity") * bonus * F.pow(F.lit(0.6), F.col("n") - 1)
    summed = hits.withColumn("term", term).groupBy("query_id", "group_id").agg(F.sum("term").alias("total"), F.count("*").alias("hits"), F.min_by(F.struct("title", "year"), "n").alias("top"))
    score = F.round(F.col("total") / F.greatest(F.lit(1), F.least("hits", F.lit(3))), 5)
    ranked = summed.withColumn("score", score).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "group_id"))).where("place <= 5")
    shown = hits.where("n <= 5").join(ranked.select("query_id", "group_id"), ["query_id", "group_id"], "left_semi")
    asked = lexical_queries._asked(spark, sf_dir)
    words = shown.select("query_id", "group_id", "n", F.posexplode("keywords").alias("at", "keyword")).join(asked, "query_id")
    met = words.where(F.arrays_overlap(lexical_queries.tokens(F.col("keyword")), F.col("asked")))
    first = met.groupBy("query_id", "group_id", F.lower("keyword").alias("folded")).agg(F.min(F.struct("n", "at", "keyword")).alias("first"))
    matched = first.groupBy("query_id", "group_id").agg(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["keyword"]).alias("matched"))
    found = ranked.join(matched, ["query_id", "group_id"], "left")
    none = F.expr("array_repeat('', 0)")
    name = F.concat(F.lit("Group "), "group_id")
    sentence = D.lexical_sentence(name, F.least("hits", F.lit(5)), D.listed_title(F.col("top.title")), F.col("top.year"), F.coalesce("matched", none), none)
    return found.select("query_id", "place", "group_id", "score", F.md5(sentence.cast("binary")).alias("sentence_md5"))


def length_order(spark, sf_dir: str) -> DataFrame:
    """Documents in order of length, then number: batches of like length for an encoder."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("length")).orderBy("length", "doc_id")


def paging(spark, sf_dir: str) -> DataFrame:
    """Where the next part of a list starts, and a page's number within bounds."""
    loaded, total = (F.col("s_suppkey") % 5 * 24).cast("int"), (F.col("s_suppkey") % 7 * 13).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", tables.next_offset(loaded, total).alias("next"), tables.clamped((F.col("s_suppkey") % 9 - 1).cast("int"), total).cast("int").alias("page"))


QUERIES = {f.__name__: f for f in (
    titles, programmes, unit_items, course_pool, recommended_people, recommended_courses, people_list, people_browse, people_found, person_fields, person_items, person_detail, checked_requests, compared_people, course_detail,
    elective_profiles, resolved_programmes, areas, summary_counts, freshness, json_values, unit_counts, shortlist, kind_buckets, peaks, profile_slugs, surname_keys, shares_and_dates,
    prompts, keyword_matches, lexical_people, length_order, paging,
)}

_PROGRAMMES = """programmes AS (
  SELECT n_nationkey AS id, r_name AS level, CASE WHEN n_nationkey % 4 <> 0 THEN left(n_name, 8) END AS area, 'N' || n_nationkey AS code, n_name AS name
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
_PEOPLE = f"""{FACTS},
people AS (
  SELECT s_suppkey, any_value(s_name) AS s_name, any_value(s_nationkey) AS s_nationkey, count(item_id) AS n_works
  FROM supplier LEFT JOIN facts ON s_suppkey = group_id GROUP BY s_suppkey)"""
_FORM = lambda n: f"CASE WHEN {n} = 1 THEN 'rad' WHEN {n} BETWEEN 2 AND 4 THEN 'rada' ELSE 'radova' END"
_QUOTED = lambda x: f"array_to_string(list_transform({x}[1:3], lambda t: '„' || t || '”'), ', ')"
_CREDITS = "CASE WHEN item_id % 3 <> 0 THEN (item_id % 14) / 2 END"
_SUFFIX = f"""coalesce(' (' || nullif(concat_ws(', ', CASE WHEN {_CREDITS} > 0 THEN regexp_replace(printf('%.1f', {_CREDITS}), '\\.?0+$', '') || ' ECTS' END,
    CASE WHEN semester > 0 THEN semester || '. semestar' END), '') || ')', '')"""
_BUCKETS = "count(*) FILTER (bucket = 'zavrsni') AS zavrsni, count(*) FILTER (bucket = 'diplomski') AS diplomski, count(*) FILTER (bucket = 'doktorski') AS doktorski, count(*) FILTER (bucket = 'ostalo') AS ostalo"
_MONTHS = ", ".join(f"'{m}'" for m in D.MONTHS)
_TELLING = f"length({sql.fold('w')}) >= {T.MIN_TOKEN} AND NOT regexp_full_match({sql.fold('w')}, '\\p{{N}}+') AND {sql.fold('w')} NOT IN ({sql._STOP})"

SQL = {
    "titles": f"""
WITH {FACTS}, t AS (SELECT item_id, coalesce(nullif(CASE WHEN item_id % 11 <> 0 THEN title END, ''), nullif(field, ''), '') AS found FROM facts)
SELECT item_id, md5(CASE WHEN trim(found) = '' THEN '{D.UNTITLED}' ELSE trim(found) END) AS listed, md5(trim(CASE WHEN found = '' THEN '{D.UNTITLED}' ELSE found END)) AS shown FROM t""",
    "programmes": f"WITH {_PROGRAMMES} SELECT * FROM programmes",
    "unit_items": f"WITH {FACTS} SELECT item_id, group_id FROM facts WHERE group_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)",
    "course_pool": f"""
WITH {ITEMS}, {SEARCHES}, offered AS (SELECT DISTINCT l_partkey AS item_id, l_linenumber AS semester FROM lineitem),
scored AS (SELECT query_id, item_id, round(list_dot_product(q.v, i.v), 9) AS similarity FROM searches q, items i),
rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id, semester) AS n FROM scored JOIN offered USING (item_id))
SELECT query_id, item_id, max(similarity) AS similarity, string_agg(semester, ',' ORDER BY semester) AS semesters, min(semester) AS semester
FROM rows WHERE n <= {COURSE_ROWS} GROUP BY query_id, item_id""",
    "recommended_people": f"""
WITH {ranking_queries._groups()},
shown AS (
  SELECT h.query_id, h.group_id, h.item_id, title, h.year, keywords, q, row_number() OVER (PARTITION BY h.query_id, h.group_id ORDER BY hybrid DESC, place) AS n
  FROM hits h JOIN it USING (item_id) JOIN qt ON qt.query_id = h.query_id WHERE (h.query_id, h.group_id) IN (SELECT (query_id, group_id) FROM best)),
words AS (SELECT query_id, group_id, n, q, unnest(keywords) AS w, unnest(range(len(keywords))) AS pos FROM shown),
terms AS (SELECT *, {sql.terms("w")} AS t FROM words),
met AS (SELECT query_id, group_id, n, pos, trim(w) AS keyword, {sql.fold("trim(w)")} AS folded FROM terms WHERE len({sql.matched("q", "t")}) > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id, folded ORDER BY n, pos) AS k FROM met),
six AS (SELECT *, row_number() OVER (PARTITION BY query_id, group_id ORDER BY n, pos) AS r FROM firsts WHERE k = 1),
listed AS (SELECT query_id, group_id, list(keyword ORDER BY r) AS matched FROM six WHERE r <= 6 GROUP BY ALL),
shared AS (SELECT query_id, group_id, count(DISTINCT n) AS n_shared FROM met GROUP BY ALL),
totals AS (SELECT query_id, group_id, count(*) AS n_hits, arg_min(title, n) AS title, min(year) FILTER (n = 1) AS year FROM shown GROUP BY ALL),
works AS (SELECT group_id, count(*) AS n_works FROM facts GROUP BY group_id),
topics AS (SELECT group_id, least(count(*), 10) AS n_topics FROM facts WHERE source = 'schedule' AND trim(title) <> '' GROUP BY group_id),
rows AS (
  SELECT b.query_id, b.final AS place, b.group_id, s_name AS full_name, s_nationkey AS unit, round(b.score, 4) AS score, coalesce(n_works, 0) AS n_works, coalesce(n_topics, 0) AS n_topics,
         coalesce(matched, []) AS matched, coalesce(n_shared, n_hits) AS k, CASE WHEN trim(title) = '' THEN '{D.UNTITLED}' ELSE trim(title) END AS title, coalesce(' (' || year || ')', '') AS said
  FROM best b JOIN supplier ON s_suppkey = b.group_id JOIN totals t ON t.query_id = b.query_id AND t.group_id = b.group_id
  LEFT JOIN listed l ON l.query_id = b.query_id AND l.group_id = b.group_id LEFT JOIN shared s ON s.query_id = b.query_id AND s.group_id = b.group_id
  LEFT JOIN works w ON w.group_id = b.group_id LEFT JOIN topics p ON p.group_id = b.group_id)
SELECT query_id, place, group_id, full_name, unit, score, n_works, n_topics, array_to_string(matched, '|') AS matched,
       'Preporučeno jer ' || full_name || ' ima ' || k || ' ' || {_FORM("k")} || CASE WHEN len(matched) > 0 THEN
         CASE WHEN k = 1 THEN ' koji dijeli ' ELSE ' koji dijele ' END || CASE WHEN len(matched) = 1 THEN 'pojam ' ELSE 'pojmove ' END || {_QUOTED("matched")} || ' — npr. '
         ELSE ' na sličnu temu, npr. ' END || '„' || title || '”' || said || '.' AS explanation
FROM rows""",
    "recommended_courses": f"""
WITH best AS ({ranking_queries.SQL["recommend_courses"]}),
words AS (SELECT item_id AS query_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS ws FROM benchmark),
folds AS (SELECT query_id, list_filter(ws, lambda w: {_TELLING}) AS ws FROM words),
asked AS (SELECT query_id, ws, list_transform(ws, lambda w: {sql.fold("w")}) AS fs FROM folds),
picked AS (SELECT query_id, list_filter(range(1, len(ws) + 1), lambda i: list_position(fs, fs[i]) = i) AS pos, ws, fs FROM asked),
bodies AS (SELECT doc_id AS item_id, {sql.terms("text")} AS t FROM documents WHERE doc_id IN (SELECT item_id FROM best)),
offered AS (SELECT l_partkey AS item_id, min(l_linenumber) AS semester FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 2 = 1 GROUP BY l_partkey),
rows AS (
  SELECT query_id, place, item_id, round(score, 4) AS score, semester,
         list_transform(list_filter(pos, lambda i: len(list_filter(t, lambda b: {sql.match("fs[i]", "b")})) > 0), lambda i: ws[i])[1:6] AS matched
  FROM best JOIN picked USING (query_id) JOIN bodies USING (item_id) LEFT JOIN offered USING (item_id))
SELECT query_id, place, item_id, score, semester, array_to_string(matched, '|') AS matched,
       CASE WHEN len(matched) > 0 THEN 'Predloženo jer se tvoji pojmovi ' || {_QUOTED("matched")} || ' poklapaju s ishodima predmeta' || {_SUFFIX} || '.'
            ELSE 'Predloženo jer se ishodi i sadržaj predmeta poklapaju s tvojim opisom interesa' || {_SUFFIX} || '.' END AS explanation
FROM rows""",
    "people_list": f"""
WITH {_PEOPLE}, chosen AS (SELECT * FROM people WHERE s_nationkey BETWEEN 3 AND 20 AND s_suppkey IN (SELECT group_id FROM facts WHERE field ILIKE '%e%'))
SELECT s_suppkey, s_name, s_nationkey, n_works, (SELECT count(*) FROM chosen) AS total FROM chosen ORDER BY n_works DESC, s_name, s_suppkey LIMIT 10 OFFSET 5""",
    "people_browse": f"""
WITH {_PEOPLE}, tagged AS (SELECT group_id, list_distinct(list(field)) AS fields FROM facts WHERE field <> '' GROUP BY group_id),
asked AS (SELECT p.*, coalesce(fields, []) AS fields FROM people p LEFT JOIN tagged ON group_id = s_suppkey WHERE contains(lower(replace(s_name, '#', ' ')), 'supplier 0')),
judged AS (SELECT *, s_nationkey BETWEEN 3 AND 20 AS by_unit, len(list_filter(fields, lambda x: contains(x, 'e'))) > 0 AS by_field FROM asked),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_works DESC, s_name, s_suppkey) AS place FROM judged WHERE by_unit AND by_field)
SELECT 'person' AS kind, NULL::VARCHAR AS value, n_works AS n, s_suppkey, place FROM ranked WHERE place BETWEEN 6 AND 15
UNION ALL SELECT 'total', NULL, count(*), NULL, NULL FROM ranked HAVING count(*) > 0
UNION ALL SELECT 'unit', CAST(s_nationkey AS VARCHAR), count(*), NULL, NULL FROM judged WHERE by_field GROUP BY s_nationkey
UNION ALL SELECT 'field', f, count(*), NULL, NULL FROM (SELECT unnest(fields) AS f FROM judged WHERE by_unit) GROUP BY f""",
    "people_found": f"""
WITH {_PEOPLE}, found AS (
  SELECT q.s_suppkey AS query_id, p.s_suppkey, p.s_name, p.n_works, CAST(row_number() OVER (PARTITION BY q.s_suppkey ORDER BY p.s_name, p.s_suppkey) AS INTEGER) AS place
  FROM people q JOIN people p ON contains(lower(replace(p.s_name, '#', ' ')), 'supplier ' || substr(q.s_name, 10, 7)) WHERE q.s_suppkey % 100 = 0)
SELECT * FROM found WHERE place <= 20""",
    "person_fields": f"""
WITH {_PEOPLE}, f AS (SELECT group_id, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM facts WHERE field <> '' GROUP BY group_id)
SELECT s_suppkey, s_name, n_works, coalesce(fields, '') AS fields FROM people LEFT JOIN f ON group_id = s_suppkey""",
    "person_detail": f"""
WITH {_PEOPLE}, f AS (SELECT group_id, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM facts WHERE field <> '' GROUP BY group_id),
listed AS (
  SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY year DESC NULLS FIRST, item_id) AS INTEGER) AS place, item_id, md5(trim(CASE WHEN title = '' THEN '{D.UNTITLED}' ELSE title END)) AS title_md5,
         year, kind, array_to_string(keywords, '|') AS keywords, CASE WHEN source = 'repo' THEN 'https://example.org/urn:' || item_id END AS url FROM facts)
SELECT s_suppkey AS group_id, s_name, s_nationkey AS unit, n_works, coalesce(fields, '') AS fields, place, item_id, title_md5, year, kind, keywords, url
FROM people LEFT JOIN f ON f.group_id = s_suppkey LEFT JOIN listed ON listed.group_id = s_suppkey""",
    "checked_requests": """
WITH made AS (
  SELECT doc_id, left(text, doc_id % 700) AS text, CAST(CASE WHEN doc_id % 9 <> 0 THEN doc_id % 60 ELSE 10 END AS INTEGER) AS top_k, repeat(lang, doc_id % 60) AS unit, repeat(source, doc_id % 30) AS field,
         CASE doc_id % 4 WHEN 0 THEN 'zavrsni' WHEN 1 THEN 'diplomski' WHEN 3 THEN 'doktorski' END AS kind FROM documents)
SELECT doc_id, top_k, concat_ws('; ', CASE WHEN coalesce(length(text), 0) = 0 THEN 'text: missing' WHEN length(text) > 500 THEN 'text: more than 500 characters' END,
  CASE WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k: not 1 to 50' END, CASE WHEN length(unit) > 100 THEN 'unit: more than 100 characters' END,
  CASE WHEN length(field) > 200 THEN 'field: more than 200 characters' END, CASE WHEN kind NOT IN ('zavrsni', 'diplomski') THEN 'kind: not zavrsni or diplomski' END) AS problems
FROM made""",
    "person_items": f"""
WITH {FACTS}, rows AS (
  SELECT group_id, item_id, title, CAST(CASE WHEN source = 'schedule' THEN {NOW} ELSE year END AS INTEGER) AS year, CASE WHEN source = 'repo' THEN 'https://example.org/urn:' || item_id END AS url, source = 'repo' AS part FROM facts)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY coalesce(year, 0) DESC, part, item_id) AS INTEGER) AS place, item_id,
       md5(trim(CASE WHEN title = '' THEN '{D.UNTITLED}' ELSE title END)) AS title_md5, year, url FROM rows""",
    "compared_people": f"""
WITH {FACTS}, wanted AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, 12), (3, 5)) t(slot, group_id)), mine AS (SELECT * FROM facts JOIN wanted USING (group_id)),
kinds AS (SELECT *, CASE WHEN item_id % 7 = 0 THEN 'ostalo' ELSE kind END AS bucket FROM mine WHERE source = 'repo'),
counts AS (SELECT slot, group_id, {_BUCKETS}, max(year) FILTER (year BETWEEN 1950 AND {NOW + 1}) AS last_year FROM kinds GROUP BY ALL),
newest AS (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(year, 0) DESC, item_id) AS k FROM kinds),
evidence AS (SELECT group_id, string_agg(item_id, ',' ORDER BY k) AS evidence FROM newest WHERE k <= 3 GROUP BY group_id),
current AS (SELECT group_id, item_id, row_number() OVER (PARTITION BY group_id ORDER BY item_id) AS k FROM mine WHERE source = 'schedule' AND trim(title) <> ''),
topics AS (SELECT group_id, string_agg(item_id, ',' ORDER BY k) AS topics FROM current WHERE k <= 5 GROUP BY group_id)
SELECT slot, group_id, zavrsni, diplomski, doktorski, ostalo, last_year, evidence, coalesce(topics, '') AS topics FROM counts JOIN evidence USING (group_id) LEFT JOIN topics USING (group_id)""",
    "course_detail": f"""
WITH {_PROGRAMMES}, offered AS (SELECT DISTINCT l_partkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
listed AS (SELECT l_partkey, string_agg(level || ':' || code, ',' ORDER BY level || ':' || code) AS programmes FROM offered JOIN programmes ON id = s_nationkey GROUP BY l_partkey)
SELECT p_partkey, p_name, coalesce(programmes, '') AS programmes FROM part LEFT JOIN listed ON l_partkey = p_partkey""",
    "elective_profiles": f"""
WITH {_PROGRAMMES}
SELECT l_partkey, string_agg(DISTINCT name, ',' ORDER BY name) AS profiles FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN programmes ON id = s_nationkey
WHERE l_returnflag = 'A' AND level = 'EUROPE' GROUP BY l_partkey""",
    "resolved_programmes": f"""
WITH {_PROGRAMMES}
SELECT c_custkey, name FROM customer JOIN programmes ON CASE WHEN c_custkey % 3 = 0 THEN id = c_nationkey + 5 ELSE c_custkey % 2 = 0 AND code = 'N' || c_nationkey END""",
    "areas": f"""
WITH {_PROGRAMMES}, listed AS (SELECT level, coalesce(area, '—') AS area, min(id) AS first, string_agg(name, ',' ORDER BY id) AS names FROM programmes GROUP BY level, coalesce(area, '—'))
SELECT level, area, CAST(row_number() OVER (PARTITION BY level ORDER BY first) AS INTEGER) AS place, names FROM listed""",
    "summary_counts": """
SELECT (SELECT count(*) FROM nation) AS programmes, (SELECT count(*) FROM part) AS courses, (SELECT count(*) FROM part WHERE p_size > 10) AS with_text,
       (SELECT count(*) FROM lineitem) AS offerings, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'A') AS electives""",
    "freshness": """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM events WHERE event_id % 4 <> 0) WHERE n = 1)
SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS finished, CAST(CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS n_warnings,
       (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM last) AS newest FROM last""",
    "json_values": """
WITH read AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k, '{"k":' || k || ',"event_type":"' || event_type || '"}' AS written FROM read""",
    "unit_counts": """
WITH counts AS (SELECT 'U' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS unit, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT unit, n, CAST(row_number() OVER (ORDER BY n DESC, unit) AS INTEGER) AS place FROM counts""",
    "shortlist": """
WITH kept AS (SELECT user_id, event_type FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1)
SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS people, count(*) FILTER (event_type NOT IN ('click', 'view')) AS courses, count(*) AS total FROM kept GROUP BY user_id""",
    "kind_buckets": f"""
WITH {FACTS}, b AS (SELECT group_id, CASE WHEN item_id % 7 < 2 THEN 'ostalo' ELSE kind END AS bucket FROM facts WHERE source = 'repo')
SELECT group_id, {_BUCKETS} FROM b GROUP BY group_id""",
    "peaks": f"""
WITH {FACTS}, c AS (SELECT group_id, year, count(*) AS n FROM facts WHERE year BETWEEN 1950 AND {NOW + 1} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, year) AS k, count(*) OVER (PARTITION BY group_id) AS years FROM c)
SELECT group_id, year AS peak, n FROM r WHERE k = 1 AND years > 1""",
    "profile_slugs": """
WITH plain AS (SELECT doc_id, regexp_replace(replace(strip_accents(lower(left(coalesce(text, ''), 80))), 'đ', 'd'), '[^a-z\\s-]', '', 'g') AS s FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '\\s+', '.', 'g') AS slug FROM plain""",
    "surname_keys": """
WITH named AS (SELECT p_partkey, p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END AS name, string_split(p_name, ' ')[1] AS single FROM part)
SELECT p_partkey, substr(name, strpos(name, ' ') + 1) || ' ' || string_split(name, ' ')[1] AS key, single FROM named""",
    "shares_and_dates": f"""
SELECT o_orderkey, CAST(floor(o_totalprice / 500000 * 100 + 0.5) AS BIGINT) || '%' AS share,
       day(o_orderdate) || '. ' || [{_MONTHS}][month(o_orderdate)] || ' ' || year(o_orderdate) || '.' AS date FROM orders""",
    "prompts": "SELECT doc_id, md5(left(coalesce(text, ''), 6000)) AS plain, md5(left('query: ' || coalesce(text, ''), 6000)) AS led FROM documents",
    "keyword_matches": f"""
WITH {FACTS}, q AS (SELECT item_id AS asked, {sql.terms("text")} AS q FROM benchmark),
words AS (SELECT item_id, q, unnest(keywords) AS w, unnest(range(len(keywords))) AS pos FROM facts JOIN q ON asked = item_id % 40),
terms AS (SELECT *, {sql.terms("w")} AS t FROM words),
met AS (SELECT item_id, trim(w) AS k, pos, row_number() OVER (PARTITION BY item_id, {sql.fold("trim(w)")} ORDER BY pos) AS n FROM terms WHERE len({sql.matched("q", "t")}) > 0),
listed AS (SELECT item_id, string_agg(k, '|' ORDER BY pos) AS matched FROM met WHERE n = 1 GROUP BY item_id)
SELECT facts.item_id, coalesce(matched, '') AS matched FROM facts JOIN q ON asked = facts.item_id % 40 LEFT JOIN listed ON listed.item_id = facts.item_id""",
    "lexical_people": f"""
WITH {lexical_queries._HITS},
scored AS (SELECT query_id, item_id, round(least(0.95::DOUBLE, 0.45::DOUBLE + 0.5::DOUBLE * (weighted / (n * 1.5::DOUBLE))), 9) AS similarity FROM hits),
placed AS (
  SELECT query_id, item_id, group_id, year, title, keywords, similarity, row_number() OVER (PARTITION BY query_id, group_id ORDER BY similarity DESC, item_id) AS n
  FROM scored JOIN facts USING (item_id) WHERE kind = 'diplomski'),
summed AS (
  SELECT query_id, group_id, sum(similarity * (1 + greatest(0, 5 - ({NOW} - coalesce(year, 0))) * 0.02::DOUBLE) * pow(0.6::DOUBLE, n - 1)) AS total, count(*) AS hits,
         arg_min(title, n) AS title, min(year) FILTER (n = 1) AS year FROM placed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, group_id) AS place FROM (SELECT *, round(total / greatest(1, least(hits, 3)), 5) AS score FROM summed)),
best AS (SELECT * FROM ranked WHERE place <= 5),
spoken AS (SELECT p.query_id, p.group_id, n, unnest(keywords) AS w, unnest(range(len(keywords))) AS pos FROM placed p JOIN best b ON b.query_id = p.query_id AND b.group_id = p.group_id WHERE n <= 5),
tokens AS (SELECT *, {lexical_queries._TOKENS("w")} AS t FROM spoken),
lists AS (SELECT item_id AS query_id, {lexical_queries._TOKENS("text")} AS q FROM benchmark),
met AS (SELECT query_id, group_id, n, pos, w, row_number() OVER (PARTITION BY query_id, group_id, lower(w) ORDER BY n, pos) AS k FROM tokens JOIN lists USING (query_id) WHERE list_has_any(t, q)),
listed AS (SELECT query_id, group_id, list(w ORDER BY n, pos) AS matched FROM met WHERE k = 1 GROUP BY ALL),
rows AS (
  SELECT b.*, coalesce(matched, []) AS matched, least(hits, 5) AS k, CASE WHEN trim(title) = '' THEN '{D.UNTITLED}' ELSE trim(title) END AS shown, coalesce(' (' || year || ')', '') AS said
  FROM best b LEFT JOIN listed l ON l.query_id = b.query_id AND l.group_id = b.group_id)
SELECT query_id, CAST(place AS INTEGER) AS place, group_id, score, md5(CASE WHEN len(matched) > 0
  THEN 'Preporučeno jer Group ' || group_id || ' ima ' || k || ' ' || {_FORM("k")} || ' koji dijele pojmove ' || {_QUOTED("matched")} || ' — npr. „' || shown || '”' || said || '.'
  ELSE 'Group ' || group_id || ' mentorira ' || k || ' ' || {_FORM("k")} || ' iz srodnih područja koji se podudaraju s tvojom temom.' END) AS sentence_md5 FROM rows""",
    "length_order": "SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS length FROM documents ORDER BY length, doc_id",
    "paging": """
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 5 * 24 < s_suppkey % 7 * 13 THEN s_suppkey % 5 * 24 END AS INTEGER) AS next,
       CAST(greatest(1, least(s_suppkey % 9 - 1, greatest(1, ceil(s_suppkey % 7 * 13 / 15)))) AS INTEGER) AS page FROM supplier""",
}

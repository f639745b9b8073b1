"""Browsing, upkeep and analytics queries over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import scoring as S
from corvane.functions import text as T
from corvane.operators import tables, typo_search
from corvane.plans import sql
from corvane.plans.standins import FACTS, PARAMS, facts, table

NOW = PARAMS.now_year


def fold_text(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.col("text")).cast("binary")).alias("folded_md5"))


def content_tokens(spark, sf_dir: str) -> DataFrame:
    held = F.explode(F.array(F.array_sort(T.content_terms(F.col("text"))))).alias("terms")  # once a document
    rows = table(spark, sf_dir, "documents").select("doc_id", held)
    return rows.select("doc_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", " ").cast("binary")).alias("terms_md5"))


def query_key(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.query_key(F.col("text")).alias("key"))


def snippet(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def names(spark, sf_dir: str) -> DataFrame:
    """Family and given name and the key of every two-word part name."""
    parts = T.name_parts(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", parts["family"].alias("family"), parts["given"].alias("given"), T.slug(parts["family"], parts["given"]).alias("slug"))


def token_search(spark, sf_dir: str) -> DataFrame:
    """Parts whose folded name holds every token of a query, whatever its accents: the words of the parts with an id divisible by 100, changed over."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    asked = F.concat_ws(" ", F.split("text", " ")[1], F.left(F.translate(F.upper("text"), "RS", "ŔŚ"), F.lit(3)))
    queries = rows.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), asked.alias("text"))
    return typo_search.matches(rows, queries, typos=False).select("query_id", F.col("item_id").alias("p_partkey"))


def recency_weight(spark, sf_dir: str) -> DataFrame:
    return facts(table(spark, sf_dir, "documents")).select("item_id", F.round(S.recency(F.col("year"), PARAMS), 9).alias("weight"))


def calibrated(spark, sf_dir: str) -> DataFrame:
    score = F.round(S.calibrated(F.col("s_acctbal") / 10000.0, S.GROUP_BAND), 6)
    return table(spark, sf_dir, "supplier").select("s_suppkey", score.alias("score"), S.level(score).alias("level"))


def plurals(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("o_custkey", T.plural(F.col("n"), "rad", "rada", "radova").alias("said"))


def content_keys(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tables.content_key(F.col("lang"), F.col("source"), F.col("text")).alias("key"))


def landing_urls(spark, sf_dir: str) -> DataFrame:
    rows = facts(table(spark, sf_dir, "documents"))
    return rows.select("item_id", T.landing_url(F.col("source"), F.concat(F.lit(" urn:"), F.col("item_id"), F.lit(" ")), "https://example.org/").alias("url"))


def embedding_texts(spark, sf_dir: str) -> DataFrame:
    rows = facts(table(spark, sf_dir, "documents"))
    joined = T.joined_texts(F.col("title"), F.when(F.col("year").isNotNull(), F.col("field")), F.col("body"))
    return rows.select("item_id", F.length(joined).alias("length"), F.md5(F.left(joined, F.lit(6000)).cast("binary")).alias("text_md5"))


def group_counts(spark, sf_dir: str) -> DataFrame:
    """Items of each field, most first."""
    rows = facts(table(spark, sf_dir, "documents")).where(F.col("field").isNotNull() & (F.col("field") != ""))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("groups"))


def source_counts(spark, sf_dir: str) -> DataFrame:
    """Published and current items of every supplier as a group, none as 0: one pass over the items."""
    rows = facts(table(spark, sf_dir, "documents"))
    counts = rows.groupBy("group_id").agg(F.count_if(F.col("source") == "repo").alias("n_repo"), F.count_if(F.col("source") == "schedule").alias("n_current"))
    people = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return people.join(counts, people["s_suppkey"] == counts["group_id"], "left").select("s_suppkey", F.coalesce("n_repo", F.lit(0)).alias("n_repo"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def latest_runs(spark, sf_dir: str) -> DataFrame:
    """The newest successful run of each source."""
    runs = table(spark, sf_dir, "events").where("event_id % 4 <> 0")
    return tables.keep_first(runs, ["event_type"], [F.desc_nulls_first("ts"), F.desc("event_id")]).select("event_type", "event_id", "value")


def newest_first(spark, sf_dir: str) -> DataFrame:
    """The items of each group by year, unknown years first."""
    order = Window.partitionBy("group_id").orderBy(F.desc_nulls_first("year"), "item_id")
    return facts(table(spark, sf_dir, "documents")).select("group_id", F.row_number().over(order).alias("place"), "item_id", F.coalesce("year", F.lit(0)).alias("year"))


def people_with_field(spark, sf_dir: str) -> DataFrame:
    """Customers with an order of a priority that matches a pattern, each once."""
    chosen = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").ilike("%high%"))
    people = table(spark, sf_dir, "customer")
    return people.join(chosen, people["c_custkey"] == chosen["o_custkey"], "left_semi").select("c_custkey", "c_name")


def people_page(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return tables.page(rows, [F.desc("c_acctbal"), F.col("c_custkey")], 50, 100).select("c_custkey", "c_acctbal")


def locale_order(spark, sf_dir: str) -> DataFrame:
    """Customers by name in Croatian order: č and ć after c, đ after d, š after s, ž after z. Digits stand in as letters."""
    name = F.translate(F.right(F.col("c_name"), F.lit(6)), "0123456789", "acčćdđesšz")
    named = table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))
    return tables.placed(named, [F.expr("name collate hr"), F.col("c_custkey")])


def people_after(spark, sf_dir: str) -> DataFrame:
    """The page of customers behind a given one, by balance and number."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return tables.after(rows, [("c_acctbal", True), ("c_custkey", False)], [5000.0, 10], 40)


def programme_order(spark, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("r_name") == "EUROPE", 0).when(F.col("r_name") == "ASIA", 1).otherwise(9)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_name", F.row_number().over(Window.orderBy(rank, F.coalesce("r_name", F.lit("")), "n_name")).alias("place"))


def offerings(spark, sf_dir: str) -> DataFrame:
    """Nations in which each part is offered: the distinct bridge, sorted by code point."""
    lines, suppliers, nations = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    bridge = lines.select("l_partkey", "l_suppkey").distinct().join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return bridge.groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("profiles"))


def most_shared(spark, sf_dir: str) -> DataFrame:
    """The elective part that most nations share."""
    rows = offerings(spark, sf_dir).join(table(spark, sf_dir, "part").where("p_size % 2 = 1"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_partkey", F.size(F.split("profiles", ",")).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(1)


def upsert(spark, sf_dir: str) -> DataFrame:
    """Suppliers as stored people, customers as incoming ones, merged by number."""
    stored = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") > 12, F.col("s_nationkey")).alias("unit"), F.col("s_acctbal").alias("balance"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") > 6, F.col("c_nationkey")).alias("unit"), F.col("c_acctbal").alias("balance"))
    return tables.merged(stored, new, ["id"], {"name": "set", "unit": "set_if_given", "balance": "fill"}).withColumn("unit", F.coalesce("unit", F.lit(-1)))


def prune(spark, sf_dir: str) -> DataFrame:
    rows = facts(table(spark, sf_dir, "documents"))
    live = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    return tables.pruned(rows, live, ["item_id"], F.col("source") == "schedule").select("item_id", "source")


def pending(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "a").otherwise("b").alias("model"))
    return tables.pending(table(spark, sf_dir, "documents"), vectors, "doc_id", F.col("text"), "a").select("doc_id")


def dedupe_first(spark, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("key"))
    return tables.keep_first(rows, ["key"], [F.col("doc_id")])


def timeline(spark, sf_dir: str) -> DataFrame:
    """Items of each group and sane year, the years between without gaps; groups with one year only are left out."""
    rows = facts(table(spark, sf_dir, "documents")).where(F.col("year").between(1950, NOW + 1))
    counts = rows.groupBy("group_id", "year").agg(F.count("*").alias("n"))
    spans = counts.groupBy("group_id").agg(F.min("year").alias("low"), F.max("year").alias("high")).where("low < high")
    years = spans.select("group_id", F.explode(F.sequence("low", "high")).alias("year"))
    return years.join(counts, ["group_id", "year"], "left").select("group_id", "year", F.coalesce("n", F.lit(0)).alias("n"))


def compare(spark, sf_dir: str) -> DataFrame:
    """Buckets of kinds and the last sane year of each group's published items."""
    rows = facts(table(spark, sf_dir, "documents")).where("source = 'repo'")
    kind = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return rows.groupBy("group_id").agg(kind("zavrsni"), kind("diplomski"), kind("doktorski"), F.max(F.when(F.col("year").between(1950, NOW + 1), F.col("year"))).alias("last_year"))


def current_topics(spark, sf_dir: str) -> DataFrame:
    """Up to ten titles of current items of each group, by item."""
    rows = facts(table(spark, sf_dir, "documents")).where((F.col("source") == "schedule") & (F.btrim("title") != ""))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy("item_id"))).where("place <= 10")
    return first.select("group_id", "place", F.btrim("title").alias("topic"))


def field_similarity(spark, sf_dir: str) -> DataFrame:
    """Groups of documents (by source) compared by shared languages and by Jaccard similarity of their titles' terms."""
    rows = facts(table(spark, sf_dir, "documents")).select(table_source().alias("unit"), "field", "title")
    units = rows.select("unit").distinct()
    fields = rows.select("unit", F.col("field").alias("value")).where("value IS NOT NULL").distinct()
    terms = rows.select("unit", F.explode(T.content_terms(F.col("title"))).alias("value")).distinct()
    pairs = units.join(units.select(F.col("unit").alias("other")), F.col("unit") < F.col("other"))
    found = _overlaps(_overlaps(pairs, fields, "fields"), terms, "terms")
    shared = F.col("both_fields") / F.greatest("n_fields", F.lit(1))
    jaccard = F.col("both_terms") / F.greatest(F.col("n_terms") + F.col("m_terms") - F.col("both_terms"), F.lit(1))
    return found.select("unit", "other", F.round(F.least(F.lit(0.9), 0.5 + 0.4 * (0.3 * shared + 0.7 * jaccard)), 6).alias("similarity"))


def _overlaps(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """pairs (unit, other) with the sizes of both units' sets (n_, m_) and of their intersection (both_); values: distinct (unit, value)."""
    sizes = values.groupBy("unit").agg(F.count("*").alias(f"n_{name}"))
    others = sizes.select(F.col("unit").alias("other"), F.col(f"n_{name}").alias(f"m_{name}"))
    both = values.join(values.select(F.col("unit").alias("other"), "value"), "value").where("unit < other").groupBy("unit", "other").agg(F.count("*").alias(f"both_{name}"))
    return pairs.join(sizes, "unit", "left").join(others, "other", "left").join(both, ["unit", "other"], "left").fillna(0, [f"n_{name}", f"m_{name}", f"both_{name}"])


def table_source():
    return F.col("kind")


def saved_items(spark, sf_dir: str) -> DataFrame:
    """What each user has saved: an item toggled an odd number of times, the last toggle first."""
    toggles = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).alias("last")).where("n % 2 = 1")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))
    return toggles.select("user_id", "event_type", place.alias("place"))


def recent_searches(spark, sf_dir: str) -> DataFrame:
    """The five latest different searches of each user, whatever their case."""
    rows = table(spark, sf_dir, "events").select("user_id", F.lower(F.concat("event_type", F.lit(" "), F.floor(F.col("value") / 20))).alias("search"), "ts", "event_id")
    last = rows.groupBy("user_id", "search").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))
    return last.select("user_id", "search", place.alias("place")).where("place <= 5")


def rate_windows(spark, sf_dir: str) -> DataFrame:
    """Requests of each user and hour beyond the limit: a tumbling window."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("hour", "ts"))
    return rows.groupBy("user_id", "at").agg(F.count("*").alias("n")).select("user_id", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "n", F.greatest(F.col("n") - 1, F.lit(0)).alias("refused"))


def page_links(spark, sf_dir: str) -> DataFrame:
    """The distinct links of all pages, from their markup."""
    found = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"href=\"([^\"#?]+)"), F.lit(1))).alias("link"))
    return found.where("link <> ''").groupBy("link").agg(F.count("*").alias("n"))


def page_titles(spark, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.btrim(F.regexp_replace(title, r"\s+", " ")).alias("title"))


QUERIES = {f.__name__: f for f in (
    fold_text, content_tokens, query_key, snippet, names, token_search, recency_weight, calibrated, plurals, content_keys, landing_urls, embedding_texts, group_counts, source_counts,
    latest_runs, newest_first, people_with_field, people_page, locale_order, people_after, programme_order, offerings, most_shared, upsert, prune, pending, dedupe_first, timeline, compare,
    current_topics, field_similarity, saved_items, recent_searches, rate_windows, page_links, page_titles,
)}

_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_SLUG = lambda x: f"regexp_replace(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SQL = {
    "fold_text": f"SELECT doc_id, md5({sql.fold('text')}) AS folded_md5 FROM documents",
    "content_tokens": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, md5(coalesce(array_to_string(t, ' '), '')) AS terms_md5 FROM (SELECT doc_id, {sql.terms('text')} AS t FROM documents)",
    "query_key": "SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM conversations",
    "snippet": f"SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN length({_FLAT}) <= 220 THEN {_FLAT} ELSE regexp_replace(left({_FLAT}, 220), ' [^ ]*$', '') || '…' END AS snippet FROM documents",
    "names": f"SELECT p_partkey, f AS family, g AS given, {_SLUG('f')} || '_' || {_SLUG('g')} AS slug FROM (SELECT p_partkey, regexp_extract(p_name, '(\\S+)$', 1) AS f, trim(regexp_replace(p_name, '(^|\\s)\\S+$', '')) AS g FROM part)",
    "token_search": """SELECT q.p_partkey AS query_id, p.p_partkey FROM part q JOIN part p ON contains(p.p_name, string_split(q.p_name, ' ')[2]) AND contains(p.p_name, trim(left(q.p_name, 3)))
WHERE q.p_partkey % 100 = 0""",
    "recency_weight": f"WITH {FACTS} SELECT item_id, round(CASE WHEN year IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, {NOW} - year) / 4.0) END, 9) AS weight FROM facts",
    "calibrated": "SELECT s_suppkey, score, CASE WHEN score >= 0.8 THEN 'very high' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM (SELECT s_suppkey, round(greatest(0.0, least(1.0, (s_acctbal / 10000.0::DOUBLE - 0.55::DOUBLE) / (1.1::DOUBLE - 0.55::DOUBLE))), 6) AS score FROM supplier)",
    "plurals": "SELECT o_custkey, n || ' ' || CASE WHEN n % 10 = 1 AND n % 100 <> 11 THEN 'rad' WHEN n % 10 BETWEEN 2 AND 4 AND n % 100 NOT BETWEEN 12 AND 14 THEN 'rada' ELSE 'radova' END AS said FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)",
    "content_keys": "SELECT doc_id, left(sha1(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')), 24) AS key FROM documents",
    "landing_urls": f"WITH {FACTS} SELECT item_id, CASE WHEN source = 'repo' THEN 'https://example.org/urn:' || item_id END AS url FROM facts",
    "embedding_texts": f"WITH {FACTS} SELECT item_id, CAST(length(t) AS INTEGER) AS length, md5(left(t, 6000)) AS text_md5 FROM (SELECT item_id, concat_ws(chr(10), CASE WHEN trim(title) <> '' THEN title END, CASE WHEN year IS NOT NULL AND trim(field) <> '' THEN field END, CASE WHEN trim(body) <> '' THEN body END) AS t FROM facts)",
    "group_counts": f"WITH {FACTS} SELECT field, count(*) AS n, count(DISTINCT group_id) AS groups FROM facts WHERE field <> '' GROUP BY field",
    "source_counts": f"WITH {FACTS} SELECT s_suppkey, count(*) FILTER (source = 'repo') AS n_repo, count(*) FILTER (source = 'schedule') AS n_current FROM supplier LEFT JOIN facts ON s_suppkey = group_id GROUP BY s_suppkey",
    "latest_runs": "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS FIRST, event_id DESC) AS n FROM events WHERE event_id % 4 <> 0) WHERE n = 1",
    "newest_first": f"WITH {FACTS} SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY year DESC NULLS FIRST, item_id) AS INTEGER) AS place, item_id, coalesce(year, 0) AS year FROM facts",
    "people_with_field": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority ILIKE '%high%')",
    "people_page": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100",
    "people_after": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 OR c_acctbal = 5000 AND c_custkey > 10 ORDER BY c_acctbal DESC, c_custkey LIMIT 40",
    "locale_order": """
WITH named AS (SELECT c_custkey, translate(right(c_name, 6), '0123456789', 'acčćdđesšz') AS name FROM customer)
SELECT c_custkey, name, row_number() OVER (ORDER BY translate(name, 'acčćdđesšz', '0123456789'), c_custkey) AS place FROM named""",
    "programme_order": "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 9 END, coalesce(r_name, ''), n_name) AS INTEGER) AS place FROM nation JOIN region ON n_regionkey = r_regionkey",
    "offerings": "SELECT l_partkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS profiles FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_partkey",
    "most_shared": "SELECT l_partkey, CAST(count(DISTINCT s_nationkey) AS INTEGER) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size % 2 = 1 GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 1",
    "upsert": "SELECT coalesce(a.s_suppkey, b.c_custkey) AS id, CASE WHEN b.c_custkey IS NOT NULL THEN c_name ELSE s_name END AS name, coalesce(CASE WHEN c_nationkey > 6 THEN c_nationkey END, CASE WHEN s_nationkey > 12 THEN s_nationkey END, -1) AS unit, coalesce(s_acctbal, c_acctbal) AS balance FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey",
    "prune": f"WITH {FACTS} SELECT item_id, source FROM facts WHERE source <> 'schedule' OR item_id IN (SELECT doc_id FROM labels)",
    "pending": "SELECT doc_id FROM documents WHERE text <> '' AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "dedupe_first": "SELECT min(doc_id) AS doc_id, md5(text) AS key FROM documents GROUP BY md5(text)",
    "timeline": f"WITH {FACTS}, c AS (SELECT group_id, year, count(*) AS n FROM facts WHERE year BETWEEN 1950 AND {NOW + 1} GROUP BY ALL), y AS (SELECT group_id, CAST(unnest(range(min(year), max(year) + 1)) AS INTEGER) AS year FROM c GROUP BY group_id HAVING min(year) < max(year)) SELECT group_id, year, coalesce(n, 0) AS n FROM y LEFT JOIN c USING (group_id, year)",
    "compare": f"WITH {FACTS} SELECT group_id, count(*) FILTER (kind = 'zavrsni') AS zavrsni, count(*) FILTER (kind = 'diplomski') AS diplomski, count(*) FILTER (kind = 'doktorski') AS doktorski, max(year) FILTER (year BETWEEN 1950 AND {NOW + 1}) AS last_year FROM facts WHERE source = 'repo' GROUP BY group_id",
    "current_topics": f"WITH {FACTS} SELECT group_id, place, topic FROM (SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY item_id) AS INTEGER) AS place, trim(title) AS topic FROM facts WHERE source = 'schedule' AND trim(title) <> '') WHERE place <= 10",
    "field_similarity": f"""WITH {FACTS}, w AS (SELECT kind AS unit, field, unnest({sql.terms('title')}) AS t FROM facts), f AS (SELECT kind AS unit, list(DISTINCT field) AS fields FROM facts GROUP BY kind), s AS (SELECT unit, list(DISTINCT t) AS terms FROM w GROUP BY unit), u AS (SELECT * FROM f LEFT JOIN s USING (unit))
SELECT a.unit, b.unit AS other, round(least(0.9, 0.5 + 0.4 * (0.3 * (len(list_intersect(a.fields, b.fields)) / greatest(len(a.fields), 1)) + 0.7 * (len(list_intersect(a.terms, b.terms)) / greatest(len(list_distinct(a.terms || b.terms)), 1)))), 6) AS similarity FROM u a JOIN u b ON a.unit < b.unit""",
    "saved_items": "SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS INTEGER) AS place FROM (SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY ALL HAVING count(*) % 2 = 1)",
    "recent_searches": "SELECT * FROM (SELECT user_id, search, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS INTEGER) AS place FROM (SELECT user_id, lower(event_type || ' ' || CAST(floor(value / 20) AS BIGINT)) AS search, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY ALL)) WHERE place <= 5",
    "rate_windows": "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS at, count(*) AS n, greatest(count(*) - 1, 0) AS refused FROM events GROUP BY user_id, date_trunc('hour', ts)",
    "page_links": "SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) AS link FROM pages) WHERE link <> '' GROUP BY link",
    "page_titles": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages",
}

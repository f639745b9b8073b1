import random

import duckdb
from pyspark.sql import functions as F

from corvane.operators import keyed, lexical, ranking_queries


def corpus(n=400, seed=1):
    """Items of words by Zipf's law, and queries of rare and common ones."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    share = [1 / (k + 1) for k in range(300)]
    items = {i: {w: rng.choice([1.0, 1.0, 1.5]) for w in rng.choices(words, share, k=rng.randint(0, 25))} for i in range(n)}
    queries = {q: list(set(rng.sample(words[60:], rng.randint(1, 5)) + rng.sample(words[:5], rng.randint(0, 3)))) for q in range(60)} | {60: [], 61: ["nowhere"], 62: ["w0"], 63: words[:30]}
    return items, queries


def frames(spark, items, queries):
    rows = [(i, w, x) for i, ws in items.items() for w, x in ws.items()]
    return lexical.postings(spark.createDataFrame(rows, "item_id long, word string, weight double")), spark.createDataFrame(list(queries.items()), "query_id long, asked array<string>")


def expected(items, queries, k):
    out = set()
    for q, asked in queries.items():
        scored = sorted(((-sum(ws[w] for w in set(asked) & ws.keys()), i, len(set(asked) & ws.keys())) for i, ws in items.items() if set(asked) & ws.keys()))
        out |= {(q, i, n, -s, place + 1) for place, (s, i, n) in enumerate(scored[:k])}
    return out


def test_best_items_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MOST", 50)
    items, queries = corpus()
    index, asked = frames(spark, items, queries)
    for k in (1, 10, 1_000):
        got = [(r["query_id"], r["item_id"], r["hits"], r["weighted"], r["place"]) for r in lexical.best_items(index, asked, k).collect()]
        assert len(got) == len(set(got)) and set(got) == expected(items, queries, k)


def test_common_lists_stay_closed(spark):
    items, queries = corpus(2_000)
    for i in range(0, 2_000, 50):
        items[i] |= {"w250": 1.5, "w251": 1.5, "w252": 1.0}
    queries = {1: ["w250", "w251", "w252", "w0"], 2: ["w0", "w1"]}
    index, asked = frames(spark, items, queries)
    _, opened = lexical.opened_words(index, asked, 5)
    words = {(r["query_id"], r["word"]) for r in opened.collect()}
    assert (1, "w250") in words and (1, "w0") not in words and (2, "w1") in words
    assert {(r["query_id"], r["item_id"]) for r in lexical.best_items(index, asked, 5).collect()} == {x[:2] for x in expected(items, queries, 5)}


def test_filled_up_by_id(spark):
    found = spark.createDataFrame([(1, 4, 0.9), (1, 0, 0.7)], "query_id long, item_id long, score double")
    queries = spark.createDataFrame([(1, 0.4), (2, 0.55)], "query_id long, base double")
    items = spark.createDataFrame([(k % 9,) for k in range(20)] + [(None,)], "item_id long")
    got = lexical.filled(found, queries, items, 3, F.col("base")).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["item_id"], r["score"]) for r in got] == [(1, 4, 0.9), (1, 0, 0.7), (1, 1, 0.4), (2, 0, 0.55), (2, 1, 0.55), (2, 2, 0.55)]
    assert lexical.filled(found.limit(0), queries, items.limit(0), 3, F.col("base")).count() == 0


def test_empty(spark):
    index, asked = frames(spark, {1: {"a": 1.0}}, {5: []})
    assert lexical.best_items(index, asked, 3).count() == 0


def test_only_words_that_are_asked_for_are_kept(spark):
    items, queries = corpus()
    rows = spark.createDataFrame([(i, w, x) for i, ws in items.items() for w, x in ws.items()], "item_id long, word string, weight double")
    asked = spark.createDataFrame([(q, ws) for q, ws in queries.items() if q % 20 == 0], "query_id long, asked array<string>")
    index = lexical.postings(rows, asked)
    wanted = {w for q, ws in queries.items() if q % 20 == 0 for w in ws}
    assert {r["word"] for r in index.rows.collect()} == {w for ws in items.values() for w in ws} & wanted
    got = {(r["query_id"], r["item_id"], r["hits"], r["weighted"], r["place"]) for r in lexical.best_items(index, asked, 10).collect()}
    assert got == {x for x in expected(items, queries, 10) if x[0] % 20 == 0}


def overlap_tables(spark, folder, n_titles, n_queries, seed=3):
    """benchmark and documents of like words with repeated and null ids; some texts are null, empty or stopwords only."""
    rng = random.Random(seed)
    words = [a + b for a in ("graf", "mrez", "baza", "kod", "signal", "slik", "vid") for b in ("", "a", "e", "ova", "ovi", "ama")]
    said = lambda most: rng.choice([None, "", "the za 12"]) if rng.random() < 0.05 else " ".join(rng.choices(words, k=rng.randint(1, most)))
    number = lambda k, n: None if k < 2 else k % (n - 3)
    queries = [(number(k, n_queries), said(6)) for k in range(n_queries)]
    titles = [(number(k, n_titles), said(4) if k % 9 else "graf mreza\nbaza", "hr", "s", 1) for k in range(n_titles)]
    spark.createDataFrame(queries, "item_id long, text string").coalesce(2).write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(titles, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")


def overlap_by_sql(folder):
    connection = duckdb.connect()
    for name in ("benchmark", "documents"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return sorted(((i, d, round(x, 6)) for i, d, x in connection.execute(ranking_queries.SQL["lexical_overlap"]).fetchall()), key=repr)


def test_overlap_of_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    overlap_tables(spark, tmp_path, 150, 40)
    want = overlap_by_sql(tmp_path)
    for terms in (200_000, 30):  # all queries at once, and in blocks
        monkeypatch.setattr(lexical, "TERMS", terms, raising=False)
        got = ranking_queries.lexical_overlap(spark, str(tmp_path)).collect()
        assert sorted(((r["item_id"], r["doc_id"], round(r["overlap"], 6)) for r in got), key=repr) == want


def test_overlap_pairs_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 1_000, raising=False)
    overlap_tables(spark, tmp_path, 600, 40)
    held = ranking_queries.lexical_overlap(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 2_000 and sum(r["count"] for r in held) == len(overlap_by_sql(tmp_path))

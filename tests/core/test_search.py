"""Name, slug and typo-tolerant search against plain comparisons of all pairs."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import fuzzy
from corvane.operators import detail_queries, identity, keyed, people_queries, typo_search
from corvane.operators.rounds import saved
from tests.core.test_identity import greedy


def fold(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalnum() else " " for c in plain).lower().split())


def searched(people, queries, threshold=72.0):
    """(query, person, inside, score) of every pair that matches; people: (id, given, family, n)."""
    out = set()
    for q, text in queries:
        asked = fold(text)
        for i, given, family, _ in people:
            one, other = f"{fold(given)} {fold(family)}".strip(), f"{fold(family)} {fold(given)}".strip()
            inside = asked in one or asked in other
            score = max(fuzzy.weighted_ratio(asked, one), fuzzy.weighted_ratio(asked, other)) if asked else 0.0
            if inside or score >= threshold:
                out.add((q, i, inside, round(score, 6)))
    return out


def misspelt(rng, text):
    letters = list(text)
    for _ in range(rng.randint(0, 3)):
        if not letters:
            break
        k = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[k] = rng.choice("abcdeć ")
        elif kind == 1:
            letters.insert(k, rng.choice("abcde"))
        else:
            letters.pop(k)
    return "".join(letters)


def test_name_search_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeć") for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6, 7, 9, 14])))
    people = [(k, word(), " ".join(word() for _ in range(rng.choice([1, 1, 1, 2]))), rng.randint(0, 9)) for k in range(220)] + [(300, None, "Abe", 1), (301, "", "", 2), (302, "Abe", None, 3)]
    texts = [misspelt(rng, f"{p[1]} {p[2]}") for p in rng.sample(people[:220], 50)] + [misspelt(rng, p[2]) for p in rng.sample(people[:220], 40)] + ["", None, "-", "a", "ć", "ab", "abc", "e d c b a", "abcdeabcdeabcde"] + [word() for _ in range(30)]
    queries = list(enumerate(texts))
    df = identity.search_people(spark.createDataFrame(people, "person_id long, given string, family string, n_items int"), spark.createDataFrame(queries, "query_id long, text string"))
    assert {(r["query_id"], r["person_id"], r["inside"], r["score"]) for r in df.collect()} == searched(people, queries)


def test_name_search_has_no_product_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MOST", 3)
    people = spark.createDataFrame([(k, "Ana", f"Mar{k}ić", k) for k in range(30)], "person_id long, given string, family string, n_items int")
    queries = spark.createDataFrame([(1, "ana mar7ic"), (2, "Marić Ana")], "query_id long, text string")
    df = identity.search_people(people, queries, most=4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert [(r["query_id"], r["person_id"]) for r in df.where("place = 1").orderBy("query_id").collect()][0] == (1, 7)
    assert df.groupBy("query_id").count().where("count <> 4").isEmpty()


def test_cases_of_the_name_search(spark):
    people = [(1, "Siniša", "Šegvić", 0), (2, "Marko", "Horvat", 0), (3, "Mirko", "Horvatić", 100), (4, "Boris", "Vrdoljak", 0), (5, "Ivana", "Kovačević", 0)]
    queries = [(1, "sinisa segvic"), (2, "Šegvić Siniša"), (3, "Vrodljak"), (4, "marko horvat"), (5, "Žnidaršič"), (6, "   ")]
    rows = identity.search_people(spark.createDataFrame(people, "person_id long, given string, family string, n_items int"), spark.createDataFrame(queries, "query_id long, text string")).orderBy("query_id", "place").collect()
    found = {}
    for r in rows:
        found.setdefault(r["query_id"], []).append(r["person_id"])
    assert found[1] == [1] and found[2] == [1] and found[3] == [4] and found[4][:2] == [2, 3] and 5 not in found and sorted(found[6]) == [1, 2, 3, 4, 5]


def test_fuzzy_people_equals_all_pairs_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size").collect()
    people = [(r[0], *r[1].split(" "), r[2]) for r in rows]
    queries = [(r[0], r[1][0] + r[1][2] + r[1][1] + r[1][3:]) for r in rows if r[0] % 100 == 0]
    size = {p[0]: p[3] for p in people}
    by = {}
    for q, i, inside, score in searched(people, queries):
        by.setdefault(q, []).append((not inside, -score, -size[i], i))
    want = {(q, x[3], k + 1) for q, found in by.items() for k, x in enumerate(sorted(found)[:50])}
    assert {(r["query_id"], r["person_id"], r["place"]) for r in people_queries.fuzzy_people(spark, sf_dir).collect()} == want


def test_identity_merge_equals_the_greedy_pass_over_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect()
    slugs = [r["p_name"].replace(" ", "_") + "_" + r["p_type"].lower() for r in rows]
    assert {r["slug"]: r["canonical"] for r in people_queries.identity_merge(spark, sf_dir).collect()} == greedy(slugs)


@pytest.mark.parametrize("threshold", [94.0, 90.0, 82.0])
def test_similar_slugs_equal_all_pairs(spark, threshold):
    rng = random.Random(3)
    base = ["_".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 16))) for _ in "xy") for _ in range(25)]
    slugs = sorted({misspelt(rng, rng.choice(base)).replace(" ", "-") for _ in range(260)} - {""})
    df = identity.similar_slugs(spark.createDataFrame(list(enumerate(slugs)), "position long, slug string"), threshold)
    want = {(a, b) for i, a in enumerate(slugs) for b in slugs[i + 1 :] if fuzzy.indel_ratio(a, b) >= threshold}
    assert {(r["a"], r["b"]) for r in df.collect()} == want


def plain_slug(text):
    text = (text or "").replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def holds(query, text, typos=True):
    hay = plain_slug(text)
    words = "".join(c if c.isalnum() else " " for c in hay).split()
    return all(t in hay or typos and (b := fuzzy.edit_budget(t)) and any(fuzzy.prefix_distance(t, w) <= b for w in words) for t in plain_slug(query).split())


@pytest.mark.parametrize("typos", [True, False])
def test_typo_search_equals_all_pairs(spark, typos, monkeypatch):
    monkeypatch.setattr(keyed, "MOST", 20)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcč") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 12, 30])))
    texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(150)] + [None, "", "c++ i c#", "2019. abc", "a-b", "đabc, Đb"]
    queries = [misspelt(rng, rng.choice([w for t in texts[:150] for w in t.split()])) + rng.choice(["", "", " " + word()]) for _ in range(120)] + ["", None, "++", "c++", "#", "2018", "b.", "abca.", "đabcc"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    df = typo_search.matches(items, spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), typos)
    want = {(q, i) for q, query in enumerate(queries) for i, text in enumerate(texts) if holds(query, text, typos)}
    got = [(r["query_id"], r["item_id"]) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_typo_filter_equals_all_pairs_of_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["doc_id"] % 40, (r["text"] or "").split("\n")[0]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    year = {i: 2000 + i % 27 if i % 17 else None for i, _, _ in rows}
    want = set()
    for q, group, title in rows:
        if q % 100:
            continue
        long = [w for w in title.split(" ") if len(w) >= 6]
        swap = lambda w: w[:1] + w[2:3] + w[1:2] + w[3:]
        query = " ".join([*map(swap, long[:1]), *(w[:4] for w in long[1:2])])
        found = sorted((i for i, g, t in rows if g == group and holds(query, t)), key=lambda i: (year[i] is not None, -(year[i] or 0), i))
        want |= {(q, i, k + 1, k // 15 + 1, -(-len(found) // 15)) for k, i in enumerate(found)}
    assert {(r["query_id"], r["item_id"], r["place"], r["page"], r["pages"]) for r in people_queries.typo_filter(spark, sf_dir).collect()} == want


def test_repeated_items_and_groups(spark):
    items = spark.createDataFrame([(1, "plava kuća", 1), (1, "plava kuća", 1), (2, "plava škola", 2), (None, "plava", 1)], "item_id long, title string, team int")
    queries = spark.createDataFrame([(7, "PLAAVA", 1), (8, "skola", 1), (9, "", 2)], "query_id long, text string, team int")
    assert sorted(tuple(r) for r in typo_search.matches(items, queries, text="title", group="team").collect()) == [(7, 1), (7, 1), (9, 2)]


def test_pages(spark):
    df = typo_search.paged(spark.createDataFrame([(1, k) for k in range(31)] + [(2, 5)], "query_id long, item_id long"), [F.col("item_id")])
    assert {(r["query_id"], r["pages"], r["page"]) for r in df.collect()} == {(1, 3, 1), (1, 3, 2), (1, 3, 3), (2, 1, 1)}


def test_names_that_hold_a_query_are_joined_on_it(spark, monkeypatch):
    monkeypatch.setattr(keyed, "MOST", 20)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abć") for _ in range(rng.choice([1, 2, 3, 5, 9])))
    people = [(k, word(), word(), k % 4) for k in range(120)] + [(200, None, "Aba", 1), (201, "", "", 2), (202, "aba", "", 3)]
    queries = list(enumerate(["", None, "a", "ć", "ab", "b a", "aba", "bc a", "cab", "zz", "abcabcabcabcabcabc", *(f"{p[2]} {p[1]}"[1:6] for p in people[:40])]))
    df = identity.search_people(spark.createDataFrame(people, "person_id long, given string, family string, n_items int"), spark.createDataFrame(queries, "query_id long, text string"), 101.0)
    got = [(r["query_id"], r["person_id"], r["inside"], r["score"]) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == searched(people, queries, 101.0)


def test_people_found_compares_no_names(spark, sf_dir):
    plan = detail_queries.people_found(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "_resemblance" not in plan and "gram" not in plan


def test_copies_of_texts_and_queries_are_searched_once(spark, monkeypatch):
    """60 copies of 40 texts asked for by 20 copies of 12 queries: what is written between the steps holds each once, but for the ids."""
    kept = []
    monkeypatch.setattr(typo_search, "saved", lambda df: kept.append(saved(df)) or kept[-1])
    monkeypatch.setattr(typo_search, "COPIES", 7)
    names = [f"{a} {b}" for a in ("large", "hot", "blue", "old", "cold") for b in ("ring", "bolt", "plate", "gear", "pipe", "rod", "nut", "cap")]
    items = spark.createDataFrame([(k, names[k % 40]) for k in range(2400)], "item_id long, text string")
    asked = [f"{b} {a[:3]}" for a in ("large", "blue", "old") for b in ("ring", "bolt", "cap", "gaer")]
    queries = spark.createDataFrame([(k, asked[k % 12]) for k in range(240)], "query_id long, text string")
    for typos in (True, False):
        got = [(r["query_id"], r["item_id"]) for r in typo_search.matches(items, queries, typos).collect()]
        assert len(got) == len(set(got)) and set(got) == {(q, i) for q in range(240) for i in range(2400) if holds(asked[q % 12], names[i % 40], typos)}
    assert sorted(df.count() for df in kept)[-4:] == [240, 240, 2400, 2400] and max(df.count() for df in kept if "row" not in df.columns and "query_id" not in df.columns) < 200

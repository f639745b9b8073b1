import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import fuzzy
from corvane.operators import identity


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_ratios():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in "ab")
        assert fuzzy.common_length(a, b) == plain_common(a, b)
    assert fuzzy.indel_ratio("abcd", "abed") == 75.0
    assert fuzzy.weighted_ratio("ana horvat", "horvat ana") == 95.0
    assert fuzzy.weighted_ratio("", "x") == 0.0


@pytest.mark.parametrize(("token", "word", "edits"), [("tehre", "there", 1), ("kat", "cat", 1), ("inform", "information", 0), ("abc", "", 3)])
def test_prefix_distance(token, word, edits):
    assert fuzzy.prefix_distance(token, word) == edits


def test_search(spark):
    people = spark.createDataFrame([(1, "Ivan", "Horvat", 3), (2, "Đuro", "Kovačić", 9), (3, "Ana", "Marić", 1), (4, "Ivana", "Horvat", 8)], "person_id long, given string, family string, n_items int")
    queries = spark.createDataFrame([(1, "horvat ivan"), (2, "kovacic"), (3, "Horavt Ivan"), (4, ""), (5, "zzzz")], "query_id long, text string")
    got = {}
    for r in identity.search_people(people, queries).orderBy("query_id", "place").collect():
        got.setdefault(r["query_id"], []).append(r["person_id"])
    assert got[1][:2] == [1, 4] and got[2] == [2] and set(got[3]) == {1, 4} and len(got[4]) == 4 and 5 not in got


def greedy(slugs):
    chosen, out = [], {}
    for s in slugs:
        if s in out:
            continue
        best = max(((fuzzy.indel_ratio(s, c), -i, c) for i, c in enumerate(chosen)), default=None)
        if best and best[0] >= 94:
            out[s] = best[2]
        else:
            chosen.append(s)
            out[s] = s
    return out


def test_identity_equals_the_greedy_pass(spark):
    rng = random.Random(4)
    base = ["_".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 14))) for _ in "xy") for _ in range(12)]
    slugs = []
    for _ in range(120):
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice("abcdefgh")
        slugs.append("".join(s))
    rows = spark.createDataFrame(list(enumerate(slugs)), "position long, slug string")
    assert {r["slug"]: r["canonical"] for r in identity.canonical(rows).collect()} == greedy(slugs)


def test_typo_filter(spark):
    rows = spark.createDataFrame([(1, "Strojno učenje u robotici"), (2, "Baze podataka"), (3, None)], "id long, title string")
    find = lambda q: [r["id"] for r in identity.typo_filter(rows, F.col("title"), q).collect()]
    assert find("stroojno ucenje") == [1] and find("baza") == [2] and find("xyz") == [] and find("robot") == [1]

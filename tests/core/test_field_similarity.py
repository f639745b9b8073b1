"""field_similarity gathers no unit's terms in one row, and equals a brute-force comparison."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.table_queries import field_similarity


def test_no_row_holds_a_units_terms(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"term{rng.randrange(400)}" for _ in range(30)) for _ in range(60)] + ["", None, "first line\nterm1 term2"]
    rows = [(k, t, rng.choice(["en", "fr", None]) if k % 3 else "en") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    terms = {r[0]: r[1] for r in docs.select("doc_id", T.content_terms(F.split(F.coalesce("text", F.lit("")), "\n")[0])).collect()}
    kinds = ("zavrsni", "diplomski", "doktorski")
    sets = {k: (set(), set()) for k in kinds}
    for i, _, lang in rows:
        fields, words = sets[kinds[i % 3]]
        fields |= {lang} - {None}
        words |= set(terms[i])
    want = []
    for a, b in combinations(sorted(kinds), 2):
        (f, s), (g, t) = sets[a], sets[b]
        want.append((a, b, round(min(0.9, 0.5 + 0.4 * (0.3 * len(f & g) / max(len(f), 1) + 0.7 * len(s & t) / max(len(s | t), 1))), 6)))
    df = field_similarity(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == want
    assert "collect_" not in df._jdf.queryExecution().optimizedPlan().toString()

"""Keys of one case and digits, and markers of examples within a run."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import secrets

LOWER, CAPITALS = "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def test_keys_of_one_case_and_parts_of_marked_runs(spark):
    rng = random.Random(5)
    keys = ["".join(rng.choice(a) for _ in range(40)) for a in (LOWER, CAPITALS) for _ in range(100)]
    mixed = "q7Zk2mXw9RtB4vNc8LpD"
    texts = [f"see {k} there" for k in keys] + [
        f"see example/{mixed}{mixed} there", f"see {mixed}{mixed}/sample/{mixed} there", f"see {keys[0]}dummy there",
        "a sampleexampledummy1placeholder of internationalisation, 00000000000000000000001 and 123e4567-e89b-12d3-a456-426614174000",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r["text"] for r in secrets.redacted(docs).orderBy("doc_id").collect()]
    assert clean[:200] == ["see [SECRET] there"] * 200
    assert clean[200:] == ["see example[SECRET] there", "see [SECRET]sample[SECRET] there", "see [SECRET]dummy there", texts[203]]
    kinds = {r["doc_id"]: r["spans"].split(":")[0] for r in secrets.spans_of(docs).select("doc_id", secrets._said(F.col("_spans")).alias("spans")).collect()}
    assert {kinds[k] for k in range(100)} == {"entropy_base36"} and {kinds[k] for k in range(100, 200)} == {"entropy_base32"}


def entropy_spans(text):
    """The spans of every class by plain windows; a window's entropy is counted anew."""
    plain = text
    for word in secrets.MARKERS:
        plain = re.sub(word, " " * len(word), plain, flags=re.IGNORECASE | re.ASCII)
    out = []
    for name, (pattern, _, bits, needs, whole) in secrets.CLASSES.items():
        for m in re.finditer(pattern, plain):
            run = m[0].lower() if name == "entropy_hex" else m[0]
            if not all(re.search(n, m[0]) for n in needs) or any(re.search(a, m[0]) for a in secrets.ALLOWED):
                continue
            hot = [w for w in range(len(run) - 19) if round(20 * math.log2(20) - sum(c * math.log2(c) for c in Counter(run[w : w + 20]).values()), 6) >= 20 * bits]
            if hot:
                start, end = (m.start(), m.end()) if whole else (m.start() + hot[0], m.start() + hot[-1] + 20)
                out.append((start, secrets.KINDS.index(name), end))
    return out


def test_entropy_of_the_whole_table_equals_plain_windows(spark, sf_dir):
    rng = random.Random(7)
    extra = [(900_000 + k, f"key {''.join(rng.choice(a) for _ in range(rng.randint(15, 60)))}Example{''.join(rng.choice(a) for _ in range(30))} ſample") for k, a in enumerate([LOWER, CAPITALS, LOWER + CAPITALS, "0123456789abcdef"] * 10)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: [tuple(x) for x in r["_spans"] if x["kind"] >= len(secrets.PATTERNS)] for r in secrets.spans_of(docs).select("doc_id", "_spans").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got == {k: sorted(entropy_spans(t)) for k, t in texts.items()}
    assert {x[1] for spans in got.values() for x in spans} == {3, 4, 5, 6}


def test_null_ids_and_repeated_rows(spark):
    key = "q7Zk2mXw9RtB4vNc8LpD"
    docs = spark.createDataFrame([(None, key), (1, key), (1, key), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in secrets.scanned(docs).collect()) == [(0, ""), (0, "entropy_base64:0:20"), (1, "entropy_base64:0:20"), (1, "entropy_base64:0:20")]

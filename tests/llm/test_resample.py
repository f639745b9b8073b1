import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from corvane.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, target, share=10, least=20, runs=1):
    """The contract, row by row; docs: (doc_id, text)."""
    grams = lambda text: [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for w in [words(text)] for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in docs for b in grams(x)), Counter(b for x in target for b in grams(x))
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + 10000) / ((s[b] + 1) * (tt + 10000)))) for b in s}
    rows = []
    for doc, text in docs:
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    assert found(resample.op11_resample(spark, sf_dir)) == expected(docs, target)


def test_crc_of_spans_of_any_length():
    data = np.frombuffer("ab ñandú x 日本語 ".encode() + b"y" * 500 + b" " + b"z" * resample.LONG, np.uint8)
    starts = np.array([0, 3, 11, 13, 23, 524, 5])
    ends = np.array([2, 10, 12, 22, 523, 524 + resample.LONG, 5])
    got = resample.crc_after(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, ends) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def corpus(n):
    rng = np.random.default_rng(3)
    vocabulary = ["apple", "Berry", "çedar", "date", "elm", "fig", "日本", "x" * 70, "7up", "a-b"]
    return [(int(k), " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for k in rng.permutation(n)]


def test_runs_of_several_words_and_shares(spark):
    rows = corpus(150)
    docs, target = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([("fig elm apple",), (None,)], "text string")
    for share, runs in ((100, 1), (37, 3), (0, 2), (1, 2)):
        assert found(resample.ranked(docs, target, share=share, runs=runs)) == expected(rows, ["fig elm apple", None], share, 20, runs)


def test_crowded_scores_are_numbered_in_slices(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 5)
    monkeypatch.setattr(resample, "noise", lambda doc_id, seed: resample.F.lit(0).cast("long"))
    rows = [*[(k, "one two three") for k in range(60)], *[(7, "one two three")] * 9, (None, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = resample.ranked(docs, docs, share=90, least=3).where("rank is not null").orderBy("rank").select("doc_id", "rank").collect()
    want = sorted((r[0] for r in rows), key=lambda x: (x is None, x or 0))[: 90 * 70 // 100]
    assert [tuple(r) for r in got] == list(zip(want, range(1, 64), strict=True))


def test_edges(spark):
    schema = "doc_id long, text string, score string, place int, _id int"
    rows = [(1, None, "a", 1, 1), (2, "", "a", 1, 1), (None, "kiwi " * 30, "a", 1, 1), (3, "kiwi " * 30, "b", 2, 2), (3, "kiwi " * 30, "b", 2, 2), (4, "plumé " * 40_000, "c", 3, 3), (5, "k" * 300_000, "c", 3, 3)]
    docs, target = spark.createDataFrame(rows, schema), spark.createDataFrame([("plumé",)], "text string")
    for mark in (["plumé"], []):
        aim = target if mark else target.limit(0)
        assert found(resample.ranked(docs, aim, share=100)) == expected([r[:2] for r in rows], mark, 100)
    drawn = resample.resampled(docs, target, share=100)
    assert drawn.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in drawn.collect()) == [0, 3, 3, 4]
    assert found(resample.ranked(docs.limit(0), target)) == []
    assert resample.resampled(docs, target, share=0).count() == 0

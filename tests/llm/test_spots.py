import hashlib
import re
import zlib

from corvane.llm import spots

COMMON = {w for words in spots.COMMON.values() for w in words.split()}


def chains(text):
    """The (anchor, content, content) chains of a text, by the docstring's words."""
    text = re.sub("([\u3040-\u30ff\u4e00-\u9fff])", r" \1 ", text or "")
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in COMMON:
            content = [x for x in words[i + 1 :] if x not in COMMON][:2]
            if len(content) == 2:
                out.add((w, *content))
    out = out or {tuple(words[i : i + 3]) for i in range(len(words) - 2) if zlib.crc32(words[i].encode()) % spots.SPARE == 0}
    return out or {tuple(words)}


TEXTS = [
    (4, "The quick brown fox is on the run, and of the old dog."),
    (1, "The quick brown fox is on the run, and of the old cat and more dogs sleep."),
    (9, "Der Hund und die Katze sind im Garten bei der alten Mauer."),
    (7, ""),
    (8, None),
    (12, "the of and"),
    (13, "Größe " * 5000 + "the end comes now"),
    (14, "Собака и кошка спят в саду у старой стены, а мышь ищет сыр под большим столом кухни"),
    (15, "犬と猫は古い壁のそばの庭で眠っています。月が出ると鼠は台所の大きな机の下で乳酪を探します"),
    (20, "The quick brown fox is on the run, and of the old dog."),
]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "f") for k, t in TEXTS], "doc_id long, text string, fingerprint string")
    rows = {r["doc_id"]: r for r in spots.printed(docs).collect()}
    order = sorted(TEXTS)
    assert len(rows) == len(order)
    for k, (doc, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        jaccard = lambda a, b: len(a & b) / len(a | b)
        assert abs(r["near_edited"] - jaccard(chains(text), chains(new))) < 1e-9
        assert abs(r["near_next"] - jaccard(chains(text), chains(after))) < 1e-9
        assert len(r["fingerprint"].split()) == len(chains(text))
    assert rows[4]["fingerprint"] == rows[20]["fingerprint"] and rows[7]["fingerprint"] == rows[8]["fingerprint"]


def test_ranges_and_repeats(spark):
    rows = [(k // 2, f"text number {k} of the red sea house", k) for k in range(400)] + [(None, "lone", 400)] + [(7, "many of the same rows here", k) for k in range(500, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _range long")
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], hashlib.md5(r[1].encode()).hexdigest()))
    jaccard = lambda a, b: round(len(a & b) / len(a | b), 9)
    want = sorted((len(t), jaccard(chains(t), chains(order[(i + 1) % len(order)][1]))) for i, (_, t, _) in enumerate(order))
    for size in (700, 1 << 20):
        assert sorted((r["n_chars"], round(r["near_next"], 9)) for r in spots.printed(docs, size).collect()) == want


def test_empty_table_and_one_row(spark):
    assert spots.printed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = spots.printed(spark.createDataFrame([(1, "the red house stands there")], "doc_id long, text string")).collect()
    assert row["near_next"] == 1.0


def test_pruned_likeness(spark):
    from pyspark.sql import functions as F

    sets = spark.createDataFrame([([1, 2, 3, 4, 5], [1, 2, 3, 4, 5]), ([1, 2, 3, 4, 5], [1, 2, 3, 4]), (list(range(50)), [1, 2])], "a array<int>, b array<int>")
    got = [r[0] for r in sets.select(spots.likeness(F.col("a"), F.col("b"), 0.8)).collect()]
    assert got == [1.0, 0.8, 0.0]

import zlib

import numpy as np
import pytest

from corvane.llm import toxicity as T

SYLLABLES = ["ta", "re", "mi", "so", "la", "ku", "ne", "po", "vi", "ço"]


def prose(rng, n):
    return ["".join(rng.choice(SYLLABLES, int(rng.integers(1, 5)))) for _ in range(n)]


def corpus(n, seed=1):
    """Texts of made-up words; those of label 1 hold one to three words of a stem with endings of their own, somewhere."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        text, label = prose(rng, int(rng.integers(3, 200))), int(k % 3 == 0)
        for _ in range(label * int(rng.integers(1, 4))):
            text.insert(int(rng.integers(0, len(text) + 1)), "grob" + "".join(rng.choice(SYLLABLES, 3)))
        rows.append((k, " ".join(text), label))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(400)
    return T.trained([r[1] for r in rows], [r[2] for r in rows], 0.3)


def score(model, texts):
    """Scores one text at a time, all windows of a text at once."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        found = T._greatest(model, *T.words(data, np.array([0, len(data)])))[0]
        slope, shift = model["curve"]
        out.append(float(T._logistic(slope * (found if np.isfinite(found) else model["out_bias"][0]) + shift)))
    return out


def test_gradients_equal_differences():
    rng = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in T.started().items() if k not in ("word", "gram")}
    for v in model.values():
        v += rng.normal(size=v.shape) * 0.3
    inputs, at = rng.normal(size=(9, 2 * T.DIM)), rng.integers(0, 9, (5, 7))
    there = np.arange(7) < np.array([7, 3, 1, 6, 7])[:, None]
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 3])
    _, found, d_inputs = T.gradients(model, inputs, at, there, y, weight)
    loss = lambda: T.gradients(model, inputs, at, there, y, weight)[0]
    for name, array, gradient in [*((k, model[k], found[k]) for k in model), ("inputs", inputs, d_inputs)]:
        for _ in range(6):
            place = tuple(int(rng.integers(0, n)) for n in array.shape)
            before = array[place]
            array[place] = before + 1e-6
            high = loss()
            array[place] = before - 1e-6
            low = loss()
            array[place] = before
            assert gradient[place] == pytest.approx((high - low) / 2e-6, rel=1e-4, abs=1e-8), name


def test_new_endings_of_a_learnt_stem_are_found(model):
    rows = corpus(300, seed=9)
    found = np.array(score(model, [r[1] for r in rows])) >= T.LEAST
    label = np.array([r[2] for r in rows]) > 0
    assert (found == label).mean() > 0.95


def test_every_window_counts(model):
    rng = np.random.default_rng(4)
    clean = prose(rng, 2_000)
    for place in (0, 1, 777, 1_990, 2_000):
        assert score(model, [" ".join([*clean[:place], "grobtare", *clean[place:]])])[0] > 3 * score(model, [" ".join(clean)])[0]


def test_windows_cover_all_words():
    for n in range(0, 200):
        for first in (True, False):
            _, at, size = T.windows(np.array([0, n]), first)
            seen = np.zeros(n, bool)
            for a, s in zip(at, size, strict=True):
                assert 0 < s <= T.WINDOW
                seen[a : a + s] = True
            assert seen.all() if first or n > T.WINDOW - T.STRIDE else not len(at)
            assert len(at) < 2 or at[-1] + size[-1] == n


def test_long_texts_have_the_same_windows_in_stretches(model, spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(prose(rng, 3_000)), "ab" * 9_000, " ".join(["x" * 1_000] * 9 + prose(rng, 50)), " " * 9_000, "Grobmila, " * 900]
    whole = score(model, texts)
    monkeypatch.setattr(T, "PASS", 700)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    got = [T._of_long(model, d) for d in data]
    slope, shift = model["curve"]
    assert [float(T._logistic(slope * (g if np.isfinite(g) else model["out_bias"][0]) + shift)) for g in got] == pytest.approx(whole, abs=1e-5)


def test_edges(spark, model):
    rows = [(1, None, 0.5, "a"), (2, "", 0.5, "a"), (None, "grobtamila", 0.5, "b"), (3, "!!! ...", 0.5, "b"), (4, "grobtamila " * 3, 0.5, "c"), (4, "grobtamila " * 3, 0.5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, place string")
    found = T.rated(docs, model)
    assert sorted(found.columns) == sorted(docs.columns)
    got = sorted(((r["doc_id"] or 0), r["score"]) for r in found.collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 4]
    assert [g[1] for g in got] == pytest.approx([score(model, [t])[0] for t in ("grobtamila", "", "", "", rows[4][1], rows[4][1])], abs=1e-5)
    assert T.rated(docs.limit(0), model).count() == 0


def test_labels_that_cannot_be_learnt_from(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(12)], "doc_id long, text string")
    for labels in ([], [(k, 1) for k in range(12)], [(None, 1), (1, None)], [(k, k % 2) for k in range(12) if zlib.crc32(str(k).encode()) % 4 == 2]):
        model = T.fitted(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in T.rated(docs, model).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    labels = [[(r[0], 1 - r[2] if h and turned else r[2]) for r, h in zip(rows, held, strict=True)] for turned in (0, 1)]
    labels[1] += [(r[0], 0) for r in rows if r[2]][:3]  # repeated: toxic if one row says so
    one, two = (T.fitted(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in labels)
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_query(spark, sf_dir):
    df = T.op12_toxicity(spark, sf_dir)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    learnt = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [r["predicted"] == learnt[r["doc_id"]] for r in rows if r["doc_id"] in learnt]
    assert np.mean(right) > 0.85

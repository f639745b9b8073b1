import hashlib
import random

from corvane.llm import suffixes


def brute(rows, depth):
    """{place of the row: (removed spans, kept bytes)} by the contract's words."""
    texts = [(k if k is not None else 1 << 70, (t or "").encode()) for k, t in rows]
    least = {}
    for k, b in texts:
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if least[b[i : i + depth]] < k:
                gone[i : i + depth] = [True] * depth
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k if k < 1 << 70 else None, len(b), sum(gone), n, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((k * 3, " ".join(parts)))
    rows += [(500, rows[5][1]), (501, None), (502, ""), (503, "a" * 400), (504, "b" + "a" * 300), (503, rows[7][1]), (None, passages[0] * 2), (505, passages[1] * 3)]
    rng.shuffle(rows)
    return rows


def test_brute_force(spark, tmp_path, monkeypatch):
    for seed, size, depth, gram in ((1, 1 << 30, 50, 24), (2, 900, 50, 24), (3, 700, 50, 8)):
        rows = corpus(seed)
        spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, block string, digest string").write.parquet(f"{tmp_path}/{seed}/documents.parquet")
        defaults = (depth, gram, size)
        monkeypatch.setattr(suffixes.planned, "__defaults__", defaults)
        got = suffixes.op10_suffixes(spark, f"{tmp_path}/{seed}").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, depth)
        for r in suffixes.deduplicated(spark.read.parquet(f"{tmp_path}/{seed}/documents.parquet")).collect():
            assert sum(e - s for s, e in zip(r["starts"], r["ends"])) == r["n_bytes"] - len(r["kept"])


def test_empty_table(spark):
    assert suffixes.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0

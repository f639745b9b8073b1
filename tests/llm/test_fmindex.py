import hashlib
import random
import re
from collections import Counter

import numpy as np

from corvane.llm import fmindex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, depth):
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    times = Counter(tuple(w[i : i + depth]) for _, w in words for i in range(len(w) - depth + 1))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - depth + 1):
            if times[tuple(w[i : i + depth])] > 1:
                gone[i : i + depth] = [True] * depth
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "é", "z y", "".join(rng.choice("abcde") for _ in range(rng.randint(1, 5)))])
    space = lambda: rng.choice([" ", " ", "  ", "\n", "\t\x0b"])
    text = lambda k: "".join(word() + space() for _ in range(k))
    passages = [text(rng.randint(20, 90)) for _ in range(6)]
    rows = [(k * 3, "".join(rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(0, 60)) for _ in range(rng.randint(0, 5)))) for k in range(n)]
    rows += [(500, rows[5][1]), (501, None), (502, ""), (503, "a " * 200), (504, "b " + "a " * 90), (503, rows[7][1]), (None, passages[0]), (505, passages[1] * 3), (506, " "), (507, "once " * 50 + "twice thrice " * 60)]
    return rows


def test_repeats_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        size = rng.integers(0, 14, rng.integers(1, 20))
        codes = rng.integers(1, rng.integers(2, 7), int(size.sum()))
        starts = np.cumsum(size) - size
        depth = 4
        all_windows = Counter(tuple(codes[s + i : s + i + depth]) for s, n in zip(starts, size) for i in range(n - depth + 1))
        want = np.zeros(len(codes), bool)
        for s, n in zip(starts, size):
            for i in range(n - depth + 1):
                want[s + i] = all_windows[tuple(codes[s + i : s + i + depth])] > 1
        assert (fmindex.repeats(codes, size, depth) == want).all()


def test_brute_force(spark, tmp_path, monkeypatch):
    for seed, size, depth, gram in ((1, 1 << 30, 35, 18), (2, 2500, 35, 18), (3, 1500, 9, 4)):
        rows = corpus(seed)
        spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, block string, digest string").write.parquet(f"{tmp_path}/{seed}/documents.parquet")
        monkeypatch.setattr(fmindex.planned, "__defaults__", (depth, gram, size))
        got = fmindex.op7_fmindex(spark, f"{tmp_path}/{seed}").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, depth)


def test_empty_table(spark):
    assert fmindex.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_ranks_in_compressed_space():
    rng = np.random.default_rng(5)
    codes = np.minimum(rng.zipf(1.3, 20_000), 4000)
    codes = np.unique(codes, return_inverse=True)[1] + 1
    index = fmindex.Index(codes, np.full(200, 100))
    starts = np.arange(200) * 101
    text = np.zeros(200 * 101, np.int64)
    inner = np.ones(len(text), bool)
    inner[starts + 100] = False
    text[inner] = codes
    unique = np.where(inner, text + 200, np.cumsum(~inner) - 1)  # each end is a symbol of its own
    last = text[fmindex.suffix_array(unique) - 1]
    symbols, at = rng.integers(0, codes.max() + 1, 3000), rng.integers(0, len(text) + 1, 3000)
    before = {s: np.concatenate([[0], np.cumsum(last == s)]) for s in np.unique(symbols)}
    assert (index.ranks(symbols, np.stack([at, at]))[1] == [before[s][i] for s, i in zip(symbols, at)]).all()
    counts = np.bincount(last)
    share = counts[counts > 0] / len(last)
    entropy = -(share * np.log2(share)).sum()
    assert (counts * index.length).sum() < (entropy + 0.1) * len(last) and index.bits < 0.8 * len(last) * int(codes.max()).bit_length() * 1.5


def test_one_symbol():
    index = fmindex.Index(np.ones(5, np.int64), np.array([5]))
    assert index.ranks(np.array([1, 0]), np.array([[6, 6]])).tolist() == [[5, 1]]
    assert fmindex.repeats(np.ones(5, np.int64), np.array([5]), 3).tolist() == [True, True, True, False, False]

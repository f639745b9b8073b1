import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import corpus_pipeline
from corvane.llm import pieces, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOLLAR = {"password", "passwd", "secret", "token", "apikey", "api_key"}


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def representatives(rows):
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def entropy_spans(text):
    out = []
    for name, (pattern, symbols, bits, needs) in secrets.CLASSES.items():
        for m in re.finditer(pattern, text):
            run = m[0]
            if all(re.search(n, run) for n in needs) and not any(re.search(a, run) for a in secrets.ALLOWED):
                fold = run.lower() if symbols == symbols.lower() else run
                hot = [i for i in range(len(fold) - 19) if round(-sum(c * math.log2(c / 20) for c in Counter(fold[i : i + 20]).values()), 6) >= bits * 20]
                if hot:
                    out.append((m.start() + hot[0], m.start() + hot[-1] + 20))
    return out


def redacted(text):
    spans = [m.span() for k, p in secrets.PATTERNS.items() for m in re.finditer(p, text) if k != "assign" or len(m[1]) >= 8] + entropy_spans(text)
    merged = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = f"{text[:a]}[SECRET]{text[b:]}"
    return text


def mixture(rows):
    """Rows as often as they are taken, by the rule of the mixing module: exact targets, then systematic sampling."""
    size = {id(r): len(WORD.findall(r["text"] or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s))
    total = {s: sum(size[id(r)] for r in by[s]) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        level = left / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and weight[s] * level > 3 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        expected = (3 * total[s] if s in capped else weight[s] * level) / total[s] if total[s] else 0
        u = int(hashlib.md5(f"mix|{s if s is not None else 'null'}".encode()).hexdigest()[:8], 16) / 2**32
        for k, r in enumerate(sorted(by[s], key=lambda r: (size[id(r)], hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:3], r["doc_id"])), 1):
            out += [r] * (math.floor(k * expected + u) - math.floor((k - 1) * expected + u))
    return out


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.rated(docs, model, ["doc_id"]).where("score >= 0.5").collect()}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] in kept]
    rows = representatives(rows)
    for r in rows:
        r["text"] = redacted(r["text"] or "")
    vocab = pieces.Vocabulary(open(pieces.VOCABULARY, "rb").read())

    def ids(text):
        found = dict(vocab.encode(set(pieces.units(text))))
        return [k for w in pieces.units(text) for k in struct.unpack(f"<{len(found[w]) // 4}i", found[w])]

    want = sorted((r["doc_id"], r["source"], ids(r["text"])) for r in mixture(rows))
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["source"], r["ids"]) for r in out.collect()) == want
    assert out.where("not round_trip").count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(1, 'x token = "abcdefgh1234" y', "en", None, 28, "z"), (1, 'x token = "abcdefgh1234" y', "en", None, 28, "z"), (2, None, None, "a", None, "w")], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
    assert corpus_pipeline.single(spark, docs, "").count() == 2
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.safe(spark, docs, "").collect()}
    assert text[1] == ("x [SECRET]\" y", 13) and text[2] == (None, None)

import struct

import pytest
import sentencepiece

from corvane.llm import pieces

TEXTS = ["Hello world", "the cat  sat   on the mat", " lead and trail ", "Größe café 日本 \U0001f600", "line\nbreak\ttab", "a▁b", "x" * 3000, "word " * 400, "", None, "Hello world", "  ", "theatre then there these theses"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.Vocabulary(open(pieces.VOCABULARY, "rb").read())


def as_unigram(model: bytes) -> bytes:
    """The same pieces and scores, read by the library as a unigram model; the scores of space runs made moderate."""

    def message(k, v):
        def varint(n):
            out = b""
            while n > 127:
                out, n = out + bytes([n & 127 | 128]), n >> 7
            return out + bytes([n])

        return varint(k << 3 | 0) + varint(v) if isinstance(v, int) else (varint(k << 3 | 5) + v if isinstance(v, tuple) is False and k == 2 and len(v) == 4 else varint(k << 3 | 2) + varint(len(v)) + v)

    out = b""
    for k, v in pieces._fields(model):
        if k == 1:
            f = dict(pieces._fields(v))
            score = struct.unpack("<f", f.get(2, b"\0" * 4))[0]
            v = message(1, f[1]) + message(2, struct.pack("<f", max(score, -40000.0))) + (message(3, f[3]) if 3 in f else b"")
            out += message(1, v)
        elif k == 2:
            kept = b"".join(message(a, b) if a not in (10, 15, 51) else b"" for a, b in pieces._fields(v) if a != 3)
            out += message(2, kept + message(3, 1))
        else:
            out += message(k, v)
    return out


def test_words_match_the_library(vocab):
    model = as_unigram(open(pieces.VOCABULARY, "rb").read())
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    own = pieces.Vocabulary(model)
    words = sorted({w for t in TEXTS if t and "▁" not in t for w in pieces.units(t) if w and " " not in w and len(w) < 100} | {"thermodynamics", "unbelievable", "naïve", "abc123def", "$$$!!"})
    found = dict(own.encode(words))
    for w in words:
        got = list(struct.unpack(f"<{len(found[w]) // 4}i", found[w]))
        assert got == library.encode(w), w


def test_shared_prefixes_change_nothing(vocab):
    words = {w for t in TEXTS if t for w in pieces.units(t)}
    together = dict(vocab.encode(words))
    for w in words:
        assert dict(vocab.encode([w]))[w] == together[w]


def test_best_path_by_brute_force(vocab):
    def every(text):
        if not text:
            yield 0.0, []
        for n in range(1, len(text) + 1):
            if text[:n] in vocab.ids:
                score, k = vocab.ids[text[:n]]
                for s, rest in every(text[n:]):
                    yield score + s, [k, *rest]

    for w in ("there", "internal", "kitten"):
        ids = list(struct.unpack(f"<{len(b := dict(vocab.encode([w]))[w]) // 4}i", b))
        score = sum(vocab.ids[vocab.bytes[k].decode()][0] for k in ids)
        assert score == max(every(f" {w}"), key=lambda x: x[0])[0]


def test_round_trip(spark):
    docs = spark.createDataFrame([(k, t, "ids") for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    tokens = pieces.encoded(docs.select("doc_id", "text"))
    rows = {r["doc_id"]: r for r in tokens.collect()}
    assert len(rows) == len(TEXTS) and all(r["round_trip"] for r in rows.values())
    assert rows[0]["ids"] == rows[10]["ids"] and rows[8]["ids"] == rows[9]["ids"] == []
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(tokens).collect()}
    assert back == {k: t or "" for k, t in enumerate(TEXTS)}


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.encoded(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, ids string, n_pieces int")
    assert pieces.encoded(clash).collect()[0]["n_pieces"] == 2


def test_query(spark, sf_dir):
    rows = pieces.op4_pieces(spark, sf_dir)
    assert rows.where("not round_trip").count() == 0


def test_long_words_are_encoded_alike(vocab, monkeypatch):
    words = ["日本語の文章はとても長いです" * 30, "abcDEF0123456789+/" * 40, "the" * 300, "ﷺ\U0001f600" * 100, " " + "x" * 500]
    short = dict(vocab.encode(words))
    monkeypatch.setattr(pieces, "LONG", 10)
    assert dict(vocab.encode(words)) == short


def test_a_very_long_word(vocab):
    word = "kvq" * 700_000
    ids = struct.unpack(f"<{len(dict(vocab.encode([word]))[word]) // 4}i", dict(vocab.encode([word]))[word])
    assert vocab.decode(ids) == word

"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a space, as the mark, and what follows it; runs of spaces stay in front of their word), which
no piece of the vocabulary crosses. The distinct words of a stretch of documents are sorted, so that they list a
trie depth-first; for each word the forward scores of the prefix that it shares with the word before are kept, and only
the new positions are scored. A document's ids are those of its words in a row. Decoding concatenates the pieces.

The vocabulary file is a parameter; characters without a piece become bytes. The scores of a unigram model are log probabilities. Those
of a merge model are ranks (0, -1, -2, ...), from which Zipf's law makes log probabilities: -log(rank + ZIPF). The driver
reads the file (half a MB) and broadcasts it. Every text is encoded whole; the words kept by a task are bounded by MOST.

Edge cases: null or empty text has no ids and decodes to the empty text; U+2581 in a text is encoded by bytes, so that decoding
gives it back; a word of more than LONG characters (scripts without spaces, encoded data) is scored by itself, in a few bytes
for each character; repeated rows each get a row; an empty table gives no
rows; columns other than doc_id and text are ignored, or kept if named.
"""

from __future__ import annotations

import math
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm import textkit
from corvane.llm.shared import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words, and bytes of their ids, that a task keeps between its batches at most.
MOST, BYTES = 300_000, 64 << 20
#: Characters of a word that is still put into the trie.
LONG = 1000
#: What is added to a rank; of 1 to 100,000, 100 gives most words the ids that merging gives them.
ZIPF = 100
_UNITS = re.compile(" *[^ ]+| +")
_NORMAL, _BYTE = 1, 6
#: The model type of a merge model in its trainer's settings.
_MERGES = 2


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Vocabulary:
    """Pieces with the space as their mark, scores, and bytes of every id."""

    def __init__(self, model: bytes):
        pieces = [dict(_fields(v)) for k, v in _fields(model) if k == 1]
        merges = any(dict(_fields(v)).get(3) == _MERGES for k, v in _fields(model) if k == 2)
        self.ids: dict[str, tuple[float, int]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for k, piece in enumerate(pieces):
            name, kind = piece[1].decode(), piece.get(3, _NORMAL)
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            score = -math.log(ZIPF - score) if merges and score <= 0 else score
            if kind == _NORMAL:
                self.ids[name.replace("▁", " ")] = (score, k)
                self.bytes.append(name.replace("▁", " ").encode())
            elif kind == _BYTE:
                self.byte_ids[int(name[3:5], 16)] = k
                self.bytes.append(bytes([int(name[3:5], 16)]))
            else:
                self.bytes.append(b"")
        self.unknown = min(s for s, _ in self.ids.values()) - 10.0
        lengths: dict[str, set[int]] = {}
        for name in self.ids:
            lengths.setdefault(name[-2:], set()).add(len(name))
        #: Lengths of the pieces that end in one character, or in two: the longest first.
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in lengths.items()}

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Each distinct word with its ids as 32-bit integers; the words need not be sorted."""
        ids, lengths, unknown = self.ids, self.lengths, self.unknown
        before, best, back = "", [0.0], [(0, 0)]
        for word in sorted(words):
            text = f" {word}"
            if len(text) > LONG:
                yield word, self._alone(text)
                continue
            shared, most = 0, min(len(before), len(text))
            while shared < most and before[shared] == text[shared]:
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                top, how, last = float("-inf"), (end - 1, -1), text[end - 1]
                for n in lengths.get(text[end - 2 : end], ()) if end > 1 else ():
                    if n <= end and (piece := ids.get(text[end - n : end])) and (score := best[end - n] + piece[0]) > top:
                        top, how = score, (end - n, piece[1])
                if piece := ids.get(last):
                    if (score := best[end - 1] + piece[0]) > top:
                        top, how = score, (end - 1, piece[1])
                elif (score := best[end - 1] + unknown) > top:
                    top, how = score, (end - 1, -1)
                best.append(top)
                back.append(how)
            found, end = [], len(text)
            while end:
                start, piece = back[end]
                if piece < 0:
                    found += [self.byte_ids[b] for b in reversed(text[start:end].encode())]
                else:
                    found.append(piece)
                end = start
            before = text
            yield word, np.array(found[::-1], np.int32).tobytes()

    def _alone(self, text: str) -> bytes:
        """The ids of one long text, by the same scores; the piece that ends at each character is kept in six bytes."""
        ids, lengths, unknown = self.ids, self.lengths, self.unknown
        best, size, last = array("d", [0.0]), array("H", [0]), array("i", [-1])
        for end in range(1, len(text) + 1):
            top, n_top, piece_top = best[end - 1] + unknown, 1, -1
            if piece := ids.get(text[end - 1]):
                top, piece_top = best[end - 1] + piece[0], piece[1]
            for n in lengths.get(text[end - 2 : end], ()) if end > 1 else ():
                if n <= end and (piece := ids.get(text[end - n : end])) and ((score := best[end - n] + piece[0]) > top or score == top and n > n_top):
                    top, n_top, piece_top = score, n, piece[1]
            best.append(top)
            size.append(n_top)
            last.append(piece_top)
        found, end = array("i"), len(text)
        while end:
            n, piece = size[end], last[end]
            found.extend([self.byte_ids[b] for b in reversed(text[end - 1].encode())] if piece < 0 else (piece,))
            end -= n
        found.reverse()
        return found.tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode()


def units(text: str) -> list[str]:
    """The marked words of a text, each without its first space."""
    if not text:
        return []
    if "  " in text or text[-1] == " ":
        return [u[1:] for u in _UNITS.findall(f" {text}")]
    return text.split(" ")


def _shared(spark, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with n_pieces, ids, and whether decoding the ids gives the text back."""
    model = _shared(docs.sparkSession, vocabulary)
    keep = [c for c in keep if c in docs.columns]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model.value)
        known: dict[str, bytes] = {}
        held = 0
        for batch, data, offsets in textkit.passes(batches, "text", 4 << 20):
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            words = [units(t.decode()) for t in texts]
            if len(known) > MOST or held > BYTES:
                known.clear()
                held = 0
            fresh = set().union(*words).difference(known)
            known.update(vocab.encode(fresh))
            held += sum(len(known[w]) for w in fresh)
            found = [b"".join(map(known.__getitem__, w)) for w in words]
            bounds = np.cumsum([0, *map(len, found)]) // 4
            ids = np.frombuffer(b"".join(found), np.int32)
            pieces = list(map(vocab.bytes.__getitem__, ids.tolist()))
            same = [b"".join(pieces[a:b])[1:] == t for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(np.diff(bounds), pa.int64()), lists, pa.array(same)], [*keep, "n_pieces", "ids", "round_trip"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(encode, ", ".join([*kinds, "n_pieces long", "ids array<int>", "round_trip boolean"]))


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of tokens and the text of their ids (null ids: the empty text)."""
    model = _shared(tokens.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary(model.value)
        for batch in batches:
            texts = [vocab.decode(x or []) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    kinds = [f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep]
    return tokens.select(*keep, "ids").mapInArrow(decode, ", ".join([*kinds, "text string"]))


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))

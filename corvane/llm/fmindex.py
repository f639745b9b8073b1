"""Substring dedup: an FM-index per shard answers where windows of words repeat.

Words covered by a window of DEPTH words whose sequence also starts anywhere else are removed. windows.py brings all equal
windows into one shard. There the shard's segments are the text of an FM-index: the Burrows-Wheeler transform of their words in
a wavelet tree shaped by their Huffman code, which compresses it to its entropy. The same segments, which are what the documents
have of windows that may repeat, are then streamed through it: backward search from an end keeps the interval of what has been
read and gives the longest match that stands at least twice (the matching statistics, as far as the threshold needs them);
windows inside such a match repeat. Many stretches advance together.

A segment that one block holds more than once is a repeat by itself, and is sent once.

Edge cases: texts of fewer than DEPTH words, null and empty ones keep all words; repeats within one document count, and so do
copies with one doc_id; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit, windows
from corvane.llm.shared import saved, table, with_once

DEPTH = 35
GRAM = 18
#: Windows that one search unit has at most, and units that are searched together.
UNIT, TOGETHER = 32, 32768


def _tokens(gram: int):
    def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, bounds = textkit.words(data, offsets)
        return textkit.grams(textkit.word_hashes(data, starts, ends), gram), bounds

    return tokens


def _symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = textkit.words(data, offsets)
    return textkit.word_hashes(data, starts, ends)


def suffix_array(ranks: np.ndarray) -> np.ndarray:
    """The order of the suffixes of ranks (0 .. below 2^31) by prefix doubling; they must differ, as they do with unique ends."""
    n, bits = len(ranks), int(ranks.max()).bit_length() + 1
    width = min(63 // bits, n)  # so many symbols make the first pass's number
    pair = np.zeros(n, np.int64)
    for k in range(width):
        pair <<= bits
        pair[: n - k] += ranks[k:] + 1
    while True:
        order = np.argsort(pair)
        new = np.ones(n, bool)
        new[1:] = pair[order][1:] != pair[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or width >= n:
            return order
        pair = rank * (n + 1)
        pair[: n - width] += rank[width:] + 1
        width *= 2


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol in a Huffman code (0: a symbol that doesn't occur)."""
    heap = [(int(c), int(s), None) for s, c in enumerate(counts) if c]
    out = np.zeros(len(counts), np.int64)
    if len(heap) == 1:
        out[heap[0][1]] = 1
        return out
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]) - len(counts), (a, b)))
    below = [(heap[0], 0)] if heap else []
    while below:
        (_, symbol, parts), bits = below.pop()
        if parts is None:
            out[symbol] = bits
        else:
            below += [(part, bits + 1) for part in parts]
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical code of each symbol, and the symbols in order of their codes."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = np.zeros(len(lengths), np.int64)
    at = bits = 0
    for symbol, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at <<= n - bits
        bits = n
        code[symbol] = at
        at += 1
    return code, order


_LOWER = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A bit vector with the number of ones before every 64 places."""

    def __init__(self, bit: np.ndarray):
        packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bit.astype(np.uint8), bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.counts = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.counts[1:])

    def before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return np.take(self.counts, word) + np.bitwise_count(np.take(self.words, word) & np.take(_LOWER, at & 63))

    @property
    def size(self) -> int:
        """Bits of memory."""
        return 8 * (self.words.nbytes + self.counts.nbytes)


class Index:
    """An FM-index of sequences of codes (1 and up), each closed by an end of its own.

    The transform is compressed to its entropy: a wavelet tree in the shape of a Huffman code, so a symbol takes as many bits,
    and a rank as many steps, as its code has; common words take few. A level holds the nodes of that depth side by side.
    """

    def __init__(self, codes: np.ndarray, size: np.ndarray):
        n = len(size)
        ends = np.cumsum(size + 1) - 1
        text = np.empty(len(codes) + n, np.int64)
        inner = np.ones(len(text), bool)
        inner[ends] = False
        text[inner] = codes + n
        text[ends] = np.arange(n)
        order = suffix_array(text)
        symbols = np.zeros(len(text), np.int64)
        symbols[inner] = codes
        last = symbols[order - 1]  # an end where a sequence starts
        counts = np.bincount(symbols, minlength=int(codes.max(initial=0)) + 1)
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.length = code_lengths(counts)
        self.code, by_code = codes_of(self.length)
        #: Of each level: its bits, where each symbol's node starts in them, and the ones before that.
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        for level in range(int(self.length.max(initial=0))):
            left = self.length[last] - 1 - level
            bits = Bits(self.code[last] >> left & 1)
            deep = by_code[self.length[by_code] > level]
            node = self.code[deep] >> (self.length[deep] - level)
            first = np.concatenate([[True], node[1:] != node[:-1]])
            begin = (np.cumsum(counts[deep]) - counts[deep])[first][np.cumsum(first) - 1]
            start, ones = np.zeros((2, len(counts)), np.int32)
            start[deep], ones[deep] = begin, bits.before(begin)
            self.levels.append((bits, start, ones))
            prefix = self.code[last] >> left
            last = last[np.argsort(prefix.astype(np.uint16) if level < 16 else prefix, kind="stable")]
            last = last[self.length[last] > level + 1]

    @property
    def bits(self) -> int:
        """Bits of memory that the levels' vectors take."""
        return sum(level[0].size for level in self.levels)

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first `at` ones of the transform; at has a column for each symbol."""
        order = np.argsort(-self.length[symbol].astype(np.int8), kind="stable")  # long codes first: a level's symbols are the first ones
        mine, place = symbol[order], at[:, order]
        code, length = self.code[mine], self.length[mine]
        live = len(mine) - np.cumsum(np.bincount(length, minlength=len(self.levels) + 1))
        for level, (bits, start, ones) in enumerate(self.levels):
            n = live[level]
            if not n:
                break
            here = mine[:n]
            found = bits.before(place[:, :n] + start[here]) - ones[here]
            one = (code[:n] >> (length[:n] - 1 - level)) & 1 > 0
            place[:, :n] = np.where(one, found, place[:, :n] - found)
        out = np.empty_like(at)
        out[:, order] = place
        return out

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of symbol followed by what has the intervals [low, high)."""
        low, high = self.ranks(symbol, np.stack([low, high])) + self.first[symbol]
        return low, high


def repeats(codes: np.ndarray, size: np.ndarray, depth: int) -> np.ndarray:
    """For every token of the sequences, whether the depth tokens from it on are a window that stands at least twice in them."""
    index = Index(codes, size)
    count = np.maximum(size - depth + 1, 0)
    units = -(-count // UNIT)  # of at most UNIT windows each, so that a long sequence is searched in many places at once
    of = np.repeat(np.arange(len(size)), units)
    place = windows.ragged(np.zeros(len(size), np.int64), units) * UNIT
    low = (np.cumsum(size) - size)[of] + place
    high = low + np.minimum(count[of] - place, UNIT)
    found = np.zeros(len(codes) + 1, np.int64)
    for k in range(0, len(low), TOGETHER):
        _search(index, codes, low[k : k + TOGETHER], high[k : k + TOGETHER], depth, found)
    return np.cumsum(found)[:-1] > 0


def _search(index: Index, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, depth: int, found: np.ndarray) -> None:
    """Add to found (differences) the windows from start to before stop that repeat, all units side by side.

    A search goes back from the end of a stretch of windows. What it cannot match any more, no window that holds it can: all
    windows from the first one up to the place where it failed are passed over at once. Where it reaches the
    first window's start, the whole stretch repeats, and the next one is twice as long; else the stretch is halved.
    """
    more, fresh = stop - start - 1, True
    while len(start):
        end = np.minimum(start + more, stop - 1) + depth
        at = end.copy()
        low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
        going = np.arange(len(at))
        while len(going):
            new_low, new_high = index.back(codes[at[going] - 1], low[going], high[going])
            good = new_high - new_low >= 2
            going = going[good]
            low[going], high[going] = new_low[good], new_high[good]
            at[going] -= 1
            going = going[at[going] > start[going]]
        hit = end - at >= depth
        np.add.at(found, at[hit], 1)
        np.add.at(found, end[hit] - depth + 1, -1)
        reached = at == start
        start = np.where(reached, end - depth + 1, np.where(more == 0, at, start))
        more = np.where(reached, 2 * more + 1, 0 if fresh else more // 2)
        left = start < stop
        start, stop, more, fresh = start[left], stop[left], more[left], False


def _shard(depth: int):
    def search(rows: pa.Table) -> pa.Table:
        block, keys, _, size, hooks, words = windows.received(rows)
        codes = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
        again = repeats(codes, size, depth)
        at = np.flatnonzero(again)
        starts = np.cumsum(size) - size
        segment = np.searchsorted(starts, at, "right") - 1
        return windows.runs(block, keys, hooks, segment, at - starts[segment], np.zeros(len(at), np.int64))

    return search


def planned(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, block_bytes: int = windows.BLOCK) -> tuple[DataFrame, windows.Blocks]:
    """What deduplicated() returns, before it is computed, and the table that it reads."""
    tokens = _tokens(gram)
    blocked = windows.blocks(docs, block_bytes)
    anchors = windows.repeated_anchors(blocked, tokens, depth, gram, True)
    sent = windows.sent_segments(blocked, anchors, tokens, _symbols, depth, gram, False)
    found = sent.groupBy("shard").applyInArrow(_shard(depth), windows.FOUND)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for batch, data, offsets, bounds, gone in windows.covered(left, right, tokens, _symbols, depth, gram, False):
            starts, ends = windows.spans(gone, bounds)
            first, last, _ = textkit.words(data, offsets)
            keep = ~gone
            spaced = data.copy()
            edge = np.bincount(first[keep], minlength=len(data) + 1) - np.bincount(last[keep], minlength=len(data) + 1)
            inside = np.cumsum(edge)[:-1] > 0
            # a kept word brings the byte after it along as its space, but for the last kept word of a row
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            kept = np.flatnonzero(keep)
            final = np.ones(len(kept), bool)
            final[:-1] = row[kept][1:] != row[kept][:-1]
            joints = last[kept[~final]]
            spaced[joints] = 0x20
            inside[joints] = True
            count = np.concatenate([[0], np.cumsum(inside)])[offsets]
            text = pa.Array.from_buffers(pa.string(), len(batch), [None, pa.py_buffer(count.astype(np.int32)), pa.py_buffer(spaced[inside])])
            out.append(pa.record_batch([batch.column("digest"), batch.column("doc_id"), batch.column("times"), pa.array(np.diff(bounds), pa.int64()), starts, ends, text], ["digest", "doc_id", "times", "n_words", "starts", "ends", "kept"]))
        return pa.Table.from_batches(out) if out else pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("times", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.string())]).empty_table()

    schema = "digest string, doc_id long, times long, n_words long, starts array<long>, ends array<long>, kept string"
    return blocked.table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, schema), blocked


def deduplicated(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, block_bytes: int = windows.BLOCK) -> DataFrame:
    """digest, least doc_id, times, n_words, the removed spans (starts, ends: word places) and the kept words, joined by a space, of every distinct text."""
    texts, blocked = planned(docs, depth, gram, block_bytes)
    texts = saved(texts, "texts")
    blocked.drop()
    return texts


def op7_fmindex(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    texts, blocked = planned(docs)
    texts = saved(texts.select("digest", "times", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), "texts")
    blocked.drop()
    return with_once(windows.named(docs).select("doc_id", "digest"), texts, "digest").drop("digest")


OP7_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM docs)),
again AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows JOIN again USING (s)),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 35 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 35 AS b FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS c FROM spans),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, flatten(list(w[c:a - 1] ORDER BY a)) || any_value(w)[max(b):] AS kept
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(coalesce(kept, w), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

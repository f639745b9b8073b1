"""Suffix-array dedup: a radix sort of suffixes by most significant digits, no deeper than the threshold.

Bytes covered by a DEPTH-byte string that also starts in a document with a smaller doc_id are removed. windows.py brings
all equal strings into one shard. There the suffixes are sorted through DEPTH bytes only: the first pass by eight
bytes, the next ones by five, each within the groups of the pass before. After a pass, groups of one suffix, or of one
document, are done; the groups that are left after the last pass are the repeated windows, and each has its least doc_id.

Edge cases: texts of fewer than DEPTH bytes, null and empty ones keep all bytes; a string that stands twice in one document
only is kept; repeated rows with one doc_id keep what they share; a null doc_id counts as larger than all others; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit, windows
from corvane.llm.shared import saved, table, with_once

DEPTH = 50
GRAM = 24


def _tokens(gram: int):
    def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = textkit.byte_sums(data)
        at = np.arange(max(0, len(data) - gram + 1))
        return textkit.span(sums, at, at + gram), offsets

    return tokens


def _symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return data


def radix_groups(text: np.ndarray, at: np.ndarray, doc: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes (as indices of at) that share their first depth bytes with one of another document, and their group.

    Most significant digits first; a suffix that is alone, or only with its own document, is dropped after any pass.
    """
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), ">u8", padded.tobytes(), strides=(1,))
    left = np.arange(len(at))
    group = np.zeros(len(at), np.int64)
    done = 0
    while done < depth and len(left):
        narrow = int(group[-1]) < 1 << 24
        width = min(depth - done, 8 if not done else 5 if narrow else 8)
        digit = eight[at[left] + done].astype(np.uint64) >> np.uint64(64 - 8 * width)
        order = np.argsort(digit) if not done else np.argsort(group.astype(np.uint64) << np.uint64(40) | digit) if narrow and width <= 5 else np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        first = np.flatnonzero(new)
        mixed = np.minimum.reduceat(doc[left], first) < np.maximum.reduceat(doc[left], first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(left))))
        group = (np.cumsum(new) - 1)[keep]
        left = left[keep]
        done += width
    return left, group


def _shard(depth: int):
    def sort(rows: pa.Table) -> pa.Table:
        block, keys, least, size, hooks, text = windows.received(rows)
        starts = np.cumsum(size) - size
        count = size - depth + 1
        at = windows.ragged(starts, count)
        segment = np.repeat(np.arange(len(size)), count)
        left, group = radix_groups(text.astype(np.uint8), at, least[segment], depth)
        if not len(left):
            return windows.runs(block, keys, hooks, left, left, left)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        smallest = np.repeat(np.minimum.reduceat(least[segment[left]], first), np.diff(np.append(first, len(left))))
        good = smallest < least[segment[left]]
        left, smallest = left[good], smallest[good]
        order = np.argsort(left)
        left, smallest = left[order], smallest[order]
        return windows.runs(block, keys, hooks, segment[left], at[left] - starts[segment[left]], smallest)

    return sort


def planned(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, block_bytes: int = windows.BLOCK) -> tuple[DataFrame, windows.Blocks]:
    """What deduplicated() returns, before it is computed, and the table that it reads."""
    tokens = _tokens(gram)
    blocked = windows.blocks(docs, block_bytes)
    anchors = windows.repeated_anchors(blocked, tokens, depth, gram, False)
    sent = windows.sent_segments(blocked, anchors, tokens, _symbols, depth, gram, True)
    found = sent.groupBy("shard").applyInArrow(_shard(depth), windows.FOUND)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for batch, data, offsets, bounds, gone in windows.covered(left, right, tokens, _symbols, depth, gram, True):
            starts, ends = windows.spans(gone, bounds)
            rest = data[~gone]
            kept = np.concatenate([[0], np.cumsum(~gone)])[bounds]
            binary = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(rest)])
            out.append(pa.record_batch([batch.column("digest"), batch.column("doc_id"), batch.column("times"), pa.array(np.diff(offsets), pa.int64()), starts, ends, binary], ["digest", "doc_id", "times", "n_bytes", "starts", "ends", "kept"]))
        return pa.Table.from_batches(out) if out else pa.schema([("digest", pa.string()), ("doc_id", pa.int64()), ("times", pa.int64()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kept", pa.binary())]).empty_table()

    schema = "digest string, doc_id long, times long, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return blocked.table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, schema), blocked


def deduplicated(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, block_bytes: int = windows.BLOCK) -> DataFrame:
    """digest, least doc_id, times, n_bytes, the removed spans (starts, ends: byte places) and the bytes kept of every distinct text.

    What is kept is that of the text's first document; of its other ones nothing is, if the text has depth bytes.
    """
    texts, blocked = planned(docs, depth, gram, block_bytes)
    texts = saved(texts, "texts")
    blocked.drop()
    return texts


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    texts, blocked = planned(docs)
    n_removed = (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed")
    texts = saved(texts.select("digest", "times", F.col("doc_id").alias("first"), "n_bytes", n_removed, F.size("starts").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "texts")
    blocked.drop()
    rows = with_once(windows.named(docs).select("doc_id", "digest"), texts, "digest")
    copy = (F.coalesce("doc_id", F.lit(windows.LAST)) > F.col("first")) & (F.col("n_bytes") >= DEPTH)
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


OP10_SQL = """
WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS t, hex(t) AS h FROM documents),
w AS (SELECT doc_id, i, t[i + 1:i + 50] AS s FROM (SELECT doc_id, t, unnest(range(0, CAST(octet_length(t) - 49 AS BIGINT))) AS i FROM docs)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN least USING (s) WHERE m < doc_id),
numbered AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM spans),
cut AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

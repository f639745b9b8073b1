"""Repeated windows of a corpus: which windows can repeat, and the shards in which they meet.

A window is DEPTH consecutive tokens of one document. Its anchor is the least hash of the GRAM-token pieces in it, so equal windows
have equal anchors wherever they stand. A segment is a maximal run of windows of one document with one anchor.

1. Distinct texts are dealt into blocks by digest and written once, bucketed by block (as many buckets as blocks, PARTS at most;
   a bucket then holds several blocks): later steps read them without a shuffle, a block at a time. A task sends a text that it meets again only once, so a group of copies of any size arrives as one row a task.
2. Each block sends its distinct anchors, packed by bucket; anchors of two blocks, or twice in one, come back.
3. Each block sends the distinct segments of those anchors to shards by anchor. All equal windows meet in one shard, and a
   segment that lies wholly in a passage that a third of all documents hold arrives once a block, not once a document.
   A segment across the passage's edge has the passage's anchor and its document's own words, so it differs from document to
   document. The windows of anchors with more than HEAVY tokens in the corpus are therefore dealt one by one, by a hash of the
   whole window: equal ones still meet, at most two a block, and no shard gets all that surrounds a common passage.
4. What an operator finds in a shard goes back to the blocks that sent the segments.

All packed rows are bounded: blocks by bytes of text (one very long document is a block's largest unit), buckets and shards
by the number of blocks that feed them. A block puts out a row for each bucket or shard that it has something for, so rows grow
with the corpus, not with its square. Segments are told apart by 128 bits, from two bases. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import Bucketed

#: Bytes of text that a block aims at.
BLOCK = 8 << 20
#: Buckets of the table of blocks, and tasks of a later step, at most.
PARTS = 20_000
#: Bytes of text that one numpy pass handles.
PASS = 1 << 20
#: Rows of a batch that a task puts out.
ROWS = 10_000
#: Tokens of segments with one anchor, over the corpus, beyond which its windows are dealt over all shards.
HEAVY = 1 << 20
#: A null doc_id as a number: after all others.
LAST = (1 << 63) - 1
#: Anchors are compared by so many low bits, besides the bucket.
_LOW = np.uint64((1 << 40) - 1)


_BLOCKED = "block int, digest string, doc_id long, times long, text string"


def named(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the text's digest."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.md5(text.cast("binary")).alias("digest"))


def _once(batches):
    """Each text once a task, and at the end the least doc_id and the number of the later rows of those met again."""
    seen: dict[str, list[int]] = {}
    schema = pa.schema([("block", pa.int32()), ("digest", pa.string()), ("doc_id", pa.int64()), ("times", pa.int64()), ("text", pa.string())])
    for batch in batches:
        fresh = np.zeros(batch.num_rows, bool)
        for i, (block, digest, doc) in enumerate(zip(batch.column("block").to_pylist(), batch.column("digest").to_pylist(), _numbers(batch.column("doc_id")).tolist(), strict=True)):
            if digest in seen:
                known = seen[digest]
                known[1], known[2] = min(known[1], doc), known[2] + 1
            else:
                seen[digest] = [block, LAST, 0]
                fresh[i] = True
        new = batch.filter(pa.array(fresh))
        columns = [new.column("block"), new.column("digest"), pa.array(_numbers(new.column("doc_id"))), pa.array(np.ones(new.num_rows, np.int64)), new.column("text").cast(pa.string())]
        yield pa.record_batch(columns, schema=schema)
    again = [(v[0], k, v[1], v[2], None) for k, v in seen.items() if v[2]]
    for at in range(0, len(again), 10_000):
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*again[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)


def _merged(rows: pa.Table) -> pa.Table:
    """One row for each digest of a block: its text, least doc_id and number of documents."""
    texts = rows.filter(pc.is_valid(rows.column("text")))
    digests = texts.column("digest").to_pylist()
    first: dict[str, int] = {}
    for i, digest in enumerate(digests):
        first.setdefault(digest, i)
    least = dict.fromkeys(first, LAST)
    times = dict.fromkeys(first, 0)
    for digest, doc, n in zip(rows.column("digest").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("times").to_pylist(), strict=True):
        least[digest] = min(least[digest], doc)
        times[digest] += n
    single = texts.take(pa.array(list(first.values()), pa.int64()))
    return pa.table({"block": single.column("block"), "digest": single.column("digest"), "doc_id": pa.array(least.values(), pa.int64()), "times": pa.array(times.values(), pa.int64()), "text": single.column("text")})


class Blocks(NamedTuple):
    """The distinct texts of a corpus (block, digest, least doc_id, times, text), the number of blocks, and of parts that hold them."""

    table: DataFrame
    n: int
    parts: int
    drop: Callable[[], None]


def blocks(docs: DataFrame, block_bytes: int = BLOCK) -> Blocks:
    """The texts of docs as a table bucketed by block."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    parts = min(n, PARTS)
    block = F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    dealt = named(docs).withColumn("block", block).mapInArrow(_once, _BLOCKED).repartition(parts, "block")
    single = dealt.groupBy("block").applyInArrow(_merged, _BLOCKED)
    table = Bucketed(single, "block", parts)
    return Blocks(table.rows, n, parts, table.drop)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    done, least = 1, x
    while done * 2 <= width:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    return np.minimum(least[: len(x) - width + 1], least[width - done :]) if done < width else least


def segments(grams: np.ndarray, bounds: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window, windows and anchor of each segment.

    grams: hashes of the gram consecutive tokens at each place; bounds: the rows' first tokens, and the end. A window's place
    is its first token.
    """
    n = int(bounds[-1])
    size = np.diff(bounds)
    whole = size >= depth
    none = np.zeros(0, np.int64)
    if n < depth or not whole.any():
        return none, none, none, np.zeros(0, np.uint64)
    anchors = sliding_min(grams[: n - gram + 1], depth - gram + 1)
    first = np.ones(len(anchors), bool)
    first[1:] = anchors[1:] != anchors[:-1]
    first[bounds[:-1][whole]] = True
    stop = bounds[1:][whole] - depth + 1  # where a row's windows end
    first[stop[stop < len(anchors)]] = True
    at = np.flatnonzero(first)
    row = np.searchsorted(bounds, at, "right") - 1
    count = np.diff(np.append(at, len(anchors)))
    good = at + depth <= bounds[row + 1]
    return row[good], at[good], count[good], anchors[at[good]]


def _packed(values: np.ndarray) -> np.ndarray:
    """The low five bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def bucket_of(anchors: np.ndarray, n: int) -> np.ndarray:
    return ((anchors >> np.uint64(40)) % np.uint64(n)).astype(np.int32)


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The buckets that occur, each with its places in order."""
    order = np.argsort(bucket, kind="stable")
    kinds, first = np.unique(bucket[order], return_index=True)
    return list(zip(kinds.tolist(), np.split(order, first[1:]), strict=True)) if len(kinds) else []


#: Tokens of a slice of texts: hashes of the grams at each token, and the rows' token bounds.
Tokens = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _levels(sizes: np.ndarray) -> np.ndarray:
    """Sizes as bytes: eight steps to each doubling, rounded up."""
    return np.ceil(8 * np.log2(np.maximum(sizes, 1))).astype(np.uint8)


def shared_anchors(rows: pa.Table, bucket: int, bound: int) -> pa.Table:
    """What each block that feeds a bucket gets back: its anchors that stand twice, and the heavy ones of them. One sort, whatever the number of blocks."""
    parts = [_unpacked(x.as_py()) for x in rows.column("low")]
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)) for x, p in zip(rows.column("twice"), parts, strict=True)]).astype(bool)
    level = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("level")])
    low = np.concatenate(parts)
    of = np.repeat(rows.column("block").to_numpy(), [len(p) for p in parts])
    order = np.argsort(low, kind="stable")
    low, of, keep, level = low[order], of[order], twice[order], level[order]
    same = low[1:] == low[:-1]
    keep[1:] |= same
    keep[:-1] |= same
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    heavy = np.repeat(np.add.reduceat(np.exp2(level / 8), first) > bound, np.diff(np.append(first, len(low))))
    low, of, heavy = low[keep], of[keep], heavy[keep]
    order = np.argsort(of, kind="stable")  # of one block still in order of the anchor
    low, of, heavy = low[order], of[order], heavy[order]
    fresh = np.ones(len(low), bool)
    fresh[1:] = (of[1:] != of[:-1]) | (low[1:] != low[:-1])
    low, of, heavy = low[fresh], of[fresh], heavy[fresh]
    blocks, first = np.unique(of, return_index=True)
    edges = np.append(first, len(of))
    anchors = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer((5 * edges).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(_packed(low)))])
    counts = np.concatenate([[0], np.cumsum(heavy)])[edges]
    heavies = pa.Array.from_buffers(pa.binary(), len(blocks), [None, pa.py_buffer((5 * counts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(_packed(low[heavy])))])
    return pa.table({"block": pa.array(blocks, pa.int32()), "bucket": pa.array(np.full(len(blocks), bucket), pa.int32()), "anchors": anchors, "heavy": heavies})


def repeated_anchors(blocked: Blocks, tokens: Tokens, depth: int, gram: int, within: bool) -> DataFrame:
    """(block, bucket, anchors, heavy): for each block its anchors that stand in another block too, or twice in it; packed.

    heavy: those with more than HEAVY tokens of segments in the corpus.

    within: an anchor that stands twice in one segment counts, too (windows may repeat within a document).
    """

    bound, n = HEAVY, blocked.n

    def sent(batches):
        for batch, data, offsets in textkit.passes(batches, "text", PASS):
            grams, bounds = tokens(data, offsets)
            row, at, count, anchors = segments(grams, bounds, depth, gram)
            load = count + depth - 1
            if within and len(at):  # such an anchor is listed twice
                size = count + depth - gram
                inner = np.add.reduceat(grams[ragged(at, size)] == np.repeat(anchors, size), np.cumsum(size) - size, dtype=np.int64) > 1
                anchors, row, load = np.concatenate([anchors, anchors[inner]]), np.concatenate([row, row[inner]]), np.concatenate([load, np.zeros(int(inner.sum()), np.int64)])
            block = batch.column("block").to_numpy()[row]
            for b in np.unique(block):
                mine = block == b
                values, of, counts = np.unique(anchors[mine], return_inverse=True, return_counts=True)
                low, twice, level = _packed(values & _LOW), counts > 1, _levels(np.bincount(of, load[mine]))
                parts = [(k, int(b), low[at].tobytes(), np.packbits(twice[at]).tobytes(), level[at].tobytes()) for k, at in _by_bucket(bucket_of(values, n))]
                for start in range(0, len(parts), ROWS):
                    columns = zip(zip(*parts[start : start + ROWS], strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)
                    yield pa.record_batch([pa.array(x, t) for x, t in columns], ["bucket", "block", "low", "twice", "level"])

    def met(key: tuple, rows: pa.Table) -> pa.Table:
        return shared_anchors(rows, key[0].as_py(), bound)

    packed = blocked.table.mapInArrow(sent, "bucket int, block int, low binary, twice binary, level binary").repartition(blocked.parts, "bucket")
    return packed.groupBy("bucket").applyInArrow(met, "block int, bucket int, anchors binary, heavy binary")


def chosen(anchors: np.ndarray, rows: pa.Table, n: int, column: str = "anchors") -> np.ndarray:
    """Which of a block's anchors are among the packed ones of rows."""
    keep = np.zeros(len(anchors), bool)
    low, places = anchors & _LOW, dict(_by_bucket(bucket_of(anchors, n)))
    for k, data in zip(rows.column("bucket").to_pylist(), rows.column(column), strict=True):
        mine = places.get(k)
        if mine is not None and data.as_py():
            keep[mine] = np.isin(low[mine], _unpacked(data.as_py()))
    return keep


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for counts[0] places, then the same for the next."""
    out = np.ones(int(counts.sum()), np.int64)
    filled = counts > 0
    starts, counts = starts[filled], counts[filled]
    if len(starts):
        out[0] = starts[0]
        out[np.cumsum(counts)[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(out)


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Ids as numbers; null stands after all."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


#: What a segment is sent as: its tokens' symbols from a slice's bytes, offsets, and the token range of each segment.
Symbols = Callable[[np.ndarray, np.ndarray], np.ndarray]

SENT = "shard int, block int, keys binary, least binary, sizes binary, hooks binary, alphabet binary, codes binary"
FOUND = "block int, keys binary, starts binary, counts binary, least binary, hooks binary"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *[(x, pa.binary()) for x in ("keys", "least", "sizes", "hooks", "alphabet", "codes")]])


def _first_two(keys: np.ndarray, docs: np.ndarray, ordered: bool) -> np.ndarray:
    """The places of the first two of each key, in order of doc_id; ordered: of two different doc_ids."""
    keys = ranked(keys)
    order = np.lexsort((docs, keys))
    if ordered and len(order):
        new = (keys[order][1:] != keys[order][:-1]) | (docs[order][1:] != docs[order][:-1])
        order = order[np.concatenate([[True], new])]
    third = np.zeros(len(order), bool)
    third[2:] = keys[order][2:] == keys[order][:-2]
    return order[~third]


def _window_keys(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The keys of all windows of the segments, PASS tokens or so at once."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // PASS)) + 1
    out = []
    for first, size in zip(np.split(starts, cut), np.split(sizes, cut), strict=True):
        at = ragged(np.cumsum(size) - size, size - depth + 1)
        out.append(segment_keys(text[ragged(first, size)], at, np.full(len(at), depth)))
    return np.concatenate(out)


def sent_segments(blocked: Blocks, anchors: DataFrame, tokens: Tokens, symbols: Symbols, depth: int, gram: int, ordered: bool) -> DataFrame:
    """The distinct segments of each block's repeated anchors, by shard: key, least doc_id, tokens, and symbols as codes of an alphabet.

    Of heavy anchors, single windows are sent, by a hash of the window; hooks has their anchors (0: a segment). ordered: as in covered().
    """
    n = blocked.n

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _SENT.empty_table()
        keys, docs, sizes, hooks, texts = [], [], [], [], []
        for batch, data, offsets in textkit.passes(left.to_batches(), "text", PASS):
            grams, bounds = tokens(data, offsets)
            row, at, count, anchor = segments(grams, bounds, depth, gram)
            good = chosen(anchor, right, n)
            row, at, size, anchor = row[good], at[good], count[good] + depth - 1, anchor[good]
            found = symbols(data, offsets)
            key = segment_keys(found, at, size)
            doc = _numbers(batch.column("doc_id"))[row]
            order = _firsts(key, doc)
            keys.append(key[order])
            docs.append(doc[order])
            sizes.append(size[order])
            hooks.append(anchor[order])
            texts.append(found[ragged(at[order], size[order])])
        keys, docs, sizes, hooks, text = map(np.concatenate, (keys, docs, sizes, hooks, texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = _firsts(keys, docs)
        keys, docs, sizes, hooks, starts = (x[order] for x in (keys, docs, sizes, hooks, starts))
        shard = bucket_of(hooks, n)
        heavy = chosen(hooks, right, n, "heavy")
        if heavy.any():
            count = sizes[heavy] - depth + 1
            at = ragged(starts[heavy], count)
            key, doc, hook = _window_keys(text, starts[heavy], sizes[heavy], depth), np.repeat(docs[heavy], count), np.repeat(hooks[heavy], count)
            two = _first_two(key, doc, ordered)
            key, doc, hook, at = key[two], doc[two], hook[two], at[two]
            dealt = (textkit.mix(key[:, 0]) % np.uint64(n)).astype(np.int32)
            keys, docs, sizes, starts, shard = (np.concatenate([x[~heavy], y]) for x, y in ((keys, key), (docs, doc), (sizes, np.full(len(at), depth)), (starts, at), (shard, dealt)))
            hooks = np.concatenate([np.zeros(int((~heavy).sum()), np.uint64), hook])
        else:
            hooks = np.zeros(len(keys), np.uint64)
        block = left.column("block")[0].as_py()
        out = []
        for k, mine in _by_bucket(shard):
            alphabet, codes = np.unique(text[ragged(starts[mine], sizes[mine])], return_inverse=True)
            codes = codes.astype(np.uint8 if len(alphabet) <= 256 else np.uint16 if len(alphabet) <= 65536 else np.uint32)
            hook = hooks[mine].tobytes() if hooks[mine].any() else b""
            out.append((k, block, keys[mine].tobytes(), docs[mine].tobytes(), sizes[mine].astype(np.int64).tobytes(), hook, alphabet.astype(np.uint64).tobytes(), codes.tobytes()))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(_SENT.types)], schema=_SENT)

    return blocked.table.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(send, SENT).repartition(blocked.parts, "shard")


_OF_BYTE = textkit.mix(np.arange(256, dtype=np.uint64) + np.uint64(1))


def segment_keys(symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes, by two bases, of segments by their symbols and size."""
    value = _OF_BYTE[symbols] if symbols.dtype == np.uint8 else textkit.mix(symbols.astype(np.uint64) + np.uint64(1))
    keys = np.empty((len(at), 2), np.uint64)
    keys[:, 0] = textkit.mix(textkit.span(textkit.prefix(value), at, at + size) + size.astype(np.uint64))
    keys[:, 1] = textkit.span(textkit.prefix(value, textkit.OTHER), at, at + size, textkit.OTHER)
    return keys


def ranked(keys: np.ndarray) -> np.ndarray:
    """Keys of two numbers as one: equal for equal keys, in order of the first number."""
    order = np.argsort(keys[:, 0])
    low, high = keys[order].T
    new = np.ones(len(keys), bool)
    new[1:] = low[1:] != low[:-1]
    if (~new[1:] & (high[1:] != high[:-1])).any():
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        low, high = keys[order].T
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _firsts(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The place of each key's row with the least doc_id."""
    ids = ranked(keys)
    order = np.lexsort((docs, ids))
    return order[np.diff(ids[order], prepend=-1) > 0]


def received(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's segments: block, key, least doc_id, size, hook, and all their symbols in a row."""

    def joined(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(x.as_py(), kind) for x in rows.column(name)]

    keys = [k.reshape(-1, 2) for k in joined("keys", np.uint64)]
    codes = [alphabet[np.frombuffer(c.as_py(), np.uint8 if len(alphabet) <= 256 else np.uint16 if len(alphabet) <= 65536 else np.uint32)] for alphabet, c in zip(joined("alphabet", np.uint64), rows.column("codes"), strict=True)]
    block = np.repeat(rows.column("block").to_numpy(), [len(k) for k in keys])
    hooks = [h if len(h) else np.zeros(len(k), np.uint64) for h, k in zip(joined("hooks", np.uint64), keys, strict=True)]
    return block, np.concatenate(keys), np.concatenate(joined("least", np.int64)), np.concatenate(joined("sizes", np.int64)), np.concatenate(hooks), np.concatenate(codes)


def runs(block: np.ndarray, keys: np.ndarray, hooks: np.ndarray, segment: np.ndarray, window: np.ndarray, least: np.ndarray) -> pa.Table:
    """Found windows (segment, window within it, least doc_id that has it) as runs, packed by block; in order of segment and window.

    hooks: the anchors of which a block gets single windows.
    """
    new = np.ones(len(segment), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(segment)))
    out = []
    for b, mine in _by_bucket(block[segment[first]]):
        at = first[mine]
        single = np.unique(hooks[segment[at]])
        out.append((b, keys[segment[at]].tobytes(), window[at].astype(np.int64).tobytes(), count[mine].astype(np.int64).tobytes(), least[at].astype(np.int64).tobytes(), single[single > 0].tobytes()))
    return pa.table({name: pa.array([x[i] for x in out], pa.int32() if not i else pa.binary()) for i, name in enumerate(("block", "keys", "starts", "counts", "least", "hooks"))})


def covered(left: pa.Table, right: pa.Table, tokens: Tokens, symbols: Symbols, depth: int, gram: int, ordered: bool):
    """Slices of a block's rows with their bytes, offsets, token bounds, and the tokens that a repeated window covers.

    ordered: a window counts where a smaller doc_id has it; else where it stands anywhere else.
    """
    slices = []
    for batch, data, offsets in textkit.passes(left.to_batches(), "text", PASS):
        grams, bounds = tokens(data, offsets)
        row, at, count, anchor = segments(grams, bounds, depth, gram)
        slices.append((batch, data, offsets, bounds, row, at, count, segment_keys(symbols(data, offsets), at, count + depth - 1), anchor))
    if not slices:
        return
    packed = {c: np.concatenate([np.frombuffer(x.as_py(), t) for x in right.column(c)] or [np.zeros(0, t)]) for c, t in (("keys", np.uint64), ("starts", np.int64), ("counts", np.int64), ("least", np.int64))}
    wanted = packed.pop("keys").reshape(-1, 2)
    n = sum(len(x[7]) for x in slices)
    ids = ranked(np.concatenate([*[x[7] for x in slices], wanted]))
    group, packed["id"] = ids[:n], ids[n:]
    docs = np.concatenate([_numbers(x[0].column("doc_id"))[x[4]] for x in slices])
    if ordered:
        least = np.full(len(ids) + 1, LAST)
        np.minimum.at(least, group, docs)
        whole = least[group] < docs
    else:
        whole = (np.bincount(group, minlength=1)[group] > 1) | (np.concatenate([x[0].column("times").to_numpy()[x[4]] for x in slices]) > 1)
    order = np.lexsort((packed["least"], packed["id"]))
    found, packed = packed, {c: x[order] for c, x in packed.items()}
    single = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("hooks")] or [np.zeros(0, np.uint64)]))
    done = 0
    for batch, data, offsets, bounds, _, at, count, key, anchor in slices:
        doc, all_of, mine = docs[done : done + len(key)], whole[done : done + len(key)], group[done : done + len(key)]
        done += len(key)
        low, high = np.searchsorted(packed["id"], mine, "left"), np.searchsorted(packed["id"], mine, "right")
        which, run = np.repeat(np.arange(len(key)), high - low), ragged(low, high - low)
        if ordered:
            good = packed["least"][run] < doc[which]
            which, run = which[good], run[good]
        start = np.concatenate([at[all_of], at[which] + packed["starts"][run]])
        end = np.concatenate([at[all_of] + count[all_of], at[which] + packed["starts"][run] + packed["counts"][run]]) + depth - 1
        apart = np.isin(anchor, single)
        if apart.any():  # their windows came back one by one
            place, of = ragged(at[apart], count[apart]), np.repeat(doc[apart], count[apart])
            own = segment_keys(symbols(data, offsets), place, np.full(len(place), depth))
            both = ranked(np.concatenate([own, wanted]))
            earliest = np.full(len(both) + 1, LAST)
            np.minimum.at(earliest, both[len(own) :], found["least"])
            hit = earliest[both[: len(own)]] < (of if ordered else LAST)
            start, end = np.concatenate([start, place[hit]]), np.concatenate([end, place[hit] + depth])
        edge = np.bincount(start, minlength=int(bounds[-1]) + 1)[: int(bounds[-1]) + 1] - np.bincount(end, minlength=int(bounds[-1]) + 1)[: int(bounds[-1]) + 1]
        yield batch, data, offsets, bounds, np.cumsum(edge)[:-1] > 0


def spans(covered: np.ndarray, bounds: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Starts and ends of each row's maximal covered runs, as places within the row."""
    before = np.concatenate([[False], covered[:-1]])
    after = np.concatenate([covered[1:], [False]])
    edges = bounds[(bounds < len(covered))]
    before[edges] = False
    inner = bounds[(bounds > 0)] - 1
    after[inner] = False
    start, end = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after) + 1
    at = np.searchsorted(start, bounds)
    base = np.repeat(bounds[:-1], np.diff(at))
    return tuple(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x - base, pa.int64())) for x in (start, end))

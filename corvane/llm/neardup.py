"""MinHash near-duplicates, with odd sketches as the check of banded candidates.

A document's set is its distinct shingles of five words (op9_neardup: two; lower-cased A-Z). SAMPLES MinHash values per set make BANDS bands of ROWS
values; a pair at 0.8 shares no band with a probability of (1 - 0.8^ROWS)^BANDS, below 1 in 300,000. The samples are
also folded into an odd sketch: a bitmap in which each sample toggles one bit. The population count of two sketches' XOR
estimates how many samples differ; a candidate goes on only if that count is possible at 0.8 but for a chance
below 1e-8. What goes on is confirmed on the full sets.

Documents of equal sets are one node from the start (a set is named by 128 bits), so copies cost nothing. A band's nodes are not
paired with each other: each is first compared with two pivots of the band, then with the member that has most links so far, and
components are formed. Bands of one such hub are then taken together as a group. Where a group still holds several
components, rows outside its largest one meet all others in cells of about CELL shingles a side, which many tasks share. A cell looks for links
between components only: pairs come from an index over the rarest shingles of each set (two sets at 0.8 share one of those, and
at a place from which 0.8 can still be reached), pass sizes and odd sketches, and are confirmed on the full sets; a pair that
earlier links have joined is passed over, so a cell of n rows puts out fewer than n links. No link between components is lost.

Edge cases: a text of fewer words than a shingle has is one shingle by itself; null, empty and blank texts have an empty set and are linked with nothing
(each is its own component and is kept); repeated rows with one doc_id share its component; a null doc_id is compared
like the others and stands after all numbers; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.components import components
from corvane.llm.shared import masked, saved, table, with_once

WORDS = 5
LEAST = 80
ROWS, BANDS = 4, 24
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch.
SKETCH = 256
#: Shingles that one side of a cell aims at.
CELL = 400_000
#: Candidate pairs that a cell handles at once.
PAIRS = 4_000_000
#: What makes the two halves of a set's name.
_SEEDS = (np.uint64(0), np.uint64(0xD6E8FEB86659FD93))
_ODD = np.random.default_rng(9).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch_limit(samples: int = SAMPLES, bits: int = SKETCH, least: float = LEAST / 100, sigmas: float = 6.0) -> int:
    """The largest XOR count that a pair at `least` gives, but for a chance of `sigmas` standard deviations."""
    differ = samples * (1 - least) + sigmas * (samples * least * (1 - least)) ** 0.5
    expected = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return int(expected + 2 * (bits / 4) ** 0.5)


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's distinct shingles, in order, and the rows' bounds."""
    starts, ends, bounds = textkit.words(data, offsets)
    one = textkit.word_hashes(data, starts, ends, lower=True)
    count = np.diff(bounds)
    grams = textkit.grams(one, words)
    row = np.repeat(np.arange(len(count)), count)
    inside = row[: len(grams)] == row[words - 1 :]
    short = np.flatnonzero((count > 0) & (count < words))
    whole = np.array([textkit.grams(one[bounds[r] : bounds[r + 1]], count[r])[0] for r in short], np.uint64)
    hashes = np.concatenate([grams[inside], textkit.mix(whole + np.uint64(1))])
    rows = np.concatenate([row[: len(grams)][inside], short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(len(count) + 1))


def minhashes(hashes: np.ndarray, bounds: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """SAMPLES minima of each non-empty set."""
    at = bounds[:-1][filled]
    return np.stack([np.minimum.reduceat(hashes * a, at) for a in _ODD], axis=1) if len(at) else np.zeros((0, SAMPLES), np.uint64)


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """SKETCH bits of each row of minima as 64-bit integers: a bit is set if an odd number of samples fall on it."""
    n = len(minima)
    bit = textkit.mix(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH)
    odd = np.bincount((np.arange(n)[:, None] * SKETCH + bit.astype(np.int64)).ravel(), minlength=n * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, SKETCH), axis=1).view(np.int64).reshape(n, SKETCH // 64)


def _binaries(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    """Each row's bytes; null where a row isn't filled."""
    width = values.itemsize * values.shape[1]
    bounds = np.concatenate([[0], np.cumsum(np.where(filled, width, 0))]).astype(np.int32)
    empty = pa.py_buffer(np.packbits(filled, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(filled), [empty, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(values[filled]))])


def _lists(values: np.ndarray, width: int, filled: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(np.where(filled, width, 0))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _sketch(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in textkit.passes(batches, "text", 1 << 20):
        hashes, bounds = sets(data, offsets, words)
        size = np.diff(bounds)
        filled = size > 0
        minima = minhashes(hashes, bounds, filled)
        node = np.zeros((len(size), 2), np.uint64)
        if len(minima):
            for k, seed in enumerate(_SEEDS):
                node[filled, k] = np.add.reduceat(textkit.mix(hashes ^ seed), bounds[:-1][filled])
            node = textkit.mix(node + size.astype(np.uint64)[:, None])
        values = textkit.mix(minima).reshape(-1, BANDS, ROWS) * np.array([1, 3, 5, 7], np.uint64)
        bands = textkit.mix(values.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("digest"), pa.array(size, pa.int64()), _binaries(node, filled), _lists(bands, BANDS, filled), _lists(odd_sketches(minima), SKETCH // 64, filled)],
            ["doc_id", "digest", "n_shingles", "node", "bands", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int = WORDS) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in textkit.passes(batches, "text", 1 << 20):
        hashes, bounds = sets(data, offsets, words)
        yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))], ["node", "shingles"])


def differing(a: Column, b: Column) -> Column:
    """The population count of two sketches' XOR."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, SKETCH // 64)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose sizes and sketches allow a link."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    sized = 100 * F.least("na", "nb") >= LEAST * F.greatest("na", "nb")
    return pairs.distinct().join(a, "a").join(b, "b").where(sized & (differing(F.col("sa"), F.col("sb")) <= sketch_limit())).select("a", "b")


def _confirmed(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs whose full sets are alike enough."""
    a = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= LEAST * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _shared_prefixes(ids: np.ndarray, bounds: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (a, b) that share one of their rarest shingles at places from which the least likeness can be reached.

    Rows are in order of size, and each row's ids in order from its rarest one. Of a pair, the longer set's prefix is as long as any
    shorter partner may ask for, and the shorter one's as a partner of its own size or more may.
    """
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(ids)) - bounds[:-1][row]
    probe = place <= size[row] - -(-LEAST * size[row] // 100)
    short = place <= size[row] - -(-2 * LEAST * size[row] // (100 + LEAST))
    order = np.flatnonzero(probe)[np.argsort(ids[probe], kind="stable")]  # within a shingle in order of row, so of size
    key, r, p = ids[order], row[order], place[order]
    first = np.searchsorted(key, key, "left")
    count = np.arange(len(key)) - first  # partners of no greater size
    cut = np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1
    for low, high in zip([0, *cut], [*cut, len(key)], strict=True):
        n = count[low:high]
        b = np.repeat(np.arange(low, high), n)
        a = np.repeat(first[low:high] - (np.cumsum(n) - n), n) + np.arange(len(b))
        good = short[order[a]]
        a, b = a[good], b[good]
        na, nb = size[r[a]], size[r[b]]
        most = np.minimum(na - p[a], nb - p[b])  # of shared shingles, from here on
        good = (100 * na >= LEAST * nb) & ((100 + LEAST) * most >= LEAST * (na + nb))
        yield r[a[good]], r[b[good]]


def _cell(cell: pa.Table) -> pa.Table:
    """Links that join the components of a cell's rows as all links between them would."""
    lists = cell.column("shingles").combine_chunks()
    given = np.asarray(lists.offsets).astype(np.int64)
    by_size = np.argsort(np.diff(given), kind="stable")
    size = np.diff(given)[by_size]
    bounds = np.concatenate([[0], np.cumsum(size)])
    spread = np.repeat(given[:-1][by_size] - bounds[:-1], size) + np.arange(bounds[-1])
    _, ids, times = np.unique(lists.values.to_numpy()[spread], return_inverse=True, return_counts=True)
    rarity = np.argsort(np.argsort(times, kind="stable"))[ids]
    ids = rarity[np.lexsort((rarity, np.repeat(np.arange(len(size)), size)))]
    sketch = cell.column("sketch").combine_chunks()
    sketch = sketch.values.to_numpy()[np.asarray(sketch.offsets)[0] :].view(np.uint64).reshape(len(size), -1)[by_size]
    component = np.unique(np.array(cell.column("component").to_pylist(), object)[by_size], return_inverse=True)[1]
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    limit, links = sketch_limit(), []
    for a, b in _shared_prefixes(ids, bounds, size):
        apart = component[a] != component[b]
        pair = np.unique(a[apart] * len(size) + b[apart])
        a, b = pair // len(size), pair % len(size)
        near = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1) <= limit
        a, b = a[near], b[near]
        starts = np.flatnonzero(np.diff(a, prepend=-1))
        for low, high in zip(starts, np.append(starts[1:], len(a))):  # noqa: B905
            i, others = a[low], b[low:high]
            others = others[component[others] != component[i]]
            if not len(others):
                continue
            own = ids[bounds[i] : bounds[i + 1]]
            mark[own] = True
            flags = mark[ids[np.concatenate([np.arange(bounds[j], bounds[j + 1]) for j in others])]]
            mark[own] = False
            shared = np.add.reduceat(flags, np.cumsum(size[others]) - size[others], dtype=np.int64)
            for j in others[100 * shared >= LEAST * (size[others] + size[i] - shared)]:
                if component[j] != component[i]:
                    component[component == component[j]] = component[i]
                    links.append((by_size[i], by_size[j]))
    node = cell.column("node").combine_chunks()
    ends = [node.take(pa.array([x[k] for x in links], pa.int64())).to_pylist() for k in (0, 1)]
    return pa.table({"a": pa.array(map(min, *ends), pa.binary()), "b": pa.array(map(max, *ends), pa.binary())})


def _cells(placed: DataFrame, cell: int) -> DataFrame:
    """(group, node, component, kind, low, high): the cells in which rows of groups with several components meet.

    placed: group, node, component, n_shingles. A group's largest component is one side, all its other rows are the rest. Each
    is dealt into parts of about cell shingles; parts of the largest meet parts of the rest (kind 0), and parts of the rest each
    other (kind 1). So a row of the largest component is sent once for each part of the rest: once, if few rows are apart from it.
    """
    sums = placed.groupBy("group", "component").agg(F.sum("n_shingles").alias("n"))
    several = sums.groupBy("group").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    parts = lambda n: F.ceil(n / cell).cast("long")
    several = saved(several.select("group", F.col("most.component").alias("largest"), parts(F.col("most.n")).alias("ours"), parts(F.col("n") - F.col("most.n")).alias("theirs")), "several")
    rows = placed.join(several, "group").withColumn("inner", F.col("component") == F.col("largest"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("ours")).otherwise(F.col("theirs"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    place = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    own = F.transform(upto(F.col("theirs")), lambda j: place(0, F.col("part"), j))
    across = F.transform(upto(F.col("ours")), lambda i: place(0, i, F.col("part")))
    among = F.transform(F.filter(upto(F.col("theirs")), lambda j: j != F.col("part")), lambda j: place(1, F.least(F.col("part"), j), F.greatest(F.col("part"), j)))
    rows = rows.select("group", "node", "component", F.explode(F.when(F.col("inner"), own).otherwise(F.concat(across, among))).alias("at"))
    return rows.select("group", "node", "component", "at.kind", "at.low", "at.high")


def _across(grouped: DataFrame, labels: DataFrame, nodes: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links between components that meet in a group (group, node), group by group in cells of bounded size.

    Where a group's rows are joined with its number of parts, that number comes from a table of its own, so that Spark may
    split a common group's rows.
    """
    placed = saved(grouped.join(labels, "node", "left").select("group", "node", F.coalesce("component", "node").alias("component")).join(nodes.select("node", "n_shingles"), "node"), "placed")
    full = shingles.join(nodes.select("node", "sketch"), "node")
    return _cells(placed, CELL).join(full, "node").groupBy("group", "kind", "low", "high").applyInArrow(_cell, "a binary, b binary").distinct()


def _links(given: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, component) of the nodes that are linked with another one."""
    banded = nodes.select("node", F.explode("bands").alias("band"))
    pivots = saved(banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "pivots")
    members = saved(banded.join(pivots, "band"), "members")
    involved = members.select("node").distinct().join(nodes.select("node", F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest")), "node")
    chosen = given.join(involved, given["doc_id"].eqNullSafe(F.col("_doc")) & (F.md5(given["text"].cast("binary")) == F.col("_digest"))).select("node", "text")
    shingles = saved(chosen.mapInArrow(lambda batches: _sets(batches, words), "node binary, shingles array<long>").dropDuplicates(["node"]), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        return saved(_confirmed(_likely(pairs, nodes), shingles), "links")

    pair = lambda c: members.where(F.col("node") != F.col(c)).select(F.least("node", c).alias("a"), F.greatest("node", c).alias("b"))
    links = compared(pair("low").union(pair("high")))
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    hubs = saved(members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("hub")), "band_hubs")
    hubbed = members.join(hubs, "band", "left").select("node", F.coalesce("hub.node", "low").alias("hub")).distinct()
    hubbed = saved(hubbed, "hubs")
    spokes = hubbed.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    links = links.union(compared(spokes))
    return components(links.union(_across(hubbed.withColumnRenamed("hub", "group"), components(links), nodes, shingles)))


def _classes(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the text's digest, n_shingles, component_id and kept of every row of docs."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = saved(given.select("*", F.md5(F.col("text").cast("binary")).alias("digest")).mapInArrow(lambda batches: _sketch(batches, words), f"doc_id {kind}, digest string, n_shingles long, node binary, bands array<long>, sketch array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("digest"))).alias("first")
    nodes = known.where("n_shingles > 0").groupBy("node").agg(first, F.count("*").alias("times"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = saved(nodes.select("node", "first.doc_id", "first.digest", "times", "n_shingles", "bands", "sketch"), "nodes")
    labels = nodes.select("node", "doc_id", "times").join(_links(given, nodes, words), "node", "left").select("node", "doc_id", "times", F.coalesce("component", "node").alias("component"))
    labels = saved(labels, "labels")
    least = saved(labels.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    named = saved(labels.join(least, "component").select("node", "times", "component_id"), "named")
    out = with_once(known.select("doc_id", "digest", "n_shingles", "node"), named, "node")
    return out.select("doc_id", "digest", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs, by shingles of some words."""
    return _classes(docs, words).drop("digest")


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs that are kept: one document of each component; repeated rows once."""
    chosen = saved(_classes(docs, words).where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "chosen")
    given, names = masked(docs, "doc_id", "text")
    given = given.withColumn("_md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = given.join(chosen, given["doc_id"].eqNullSafe(chosen["_id"]) & (given["_md5"] == chosen["_digest"]))
    return rows.dropDuplicates(["doc_id", "_md5"]).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), words=2)


OP9_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM docs)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

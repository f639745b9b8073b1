"""Whitening of vectors: blockwise TSQR of the centred rows, then a one-sided Jacobi SVD of the triangle that is left.

A vector's entries become whole numbers x = floor(SCALE * entry). The fit list holds each distinct x once. Its count and exact
sums give the mean; every task reduces its centred rows to a triangle R block by block (R of the rows so far stacked on the next
block), triangles are stacked FAN at a time until one is left, and plane rotations make that one's columns orthogonal: their
lengths are the singular values, and the accumulated rotations the components. No Gram matrix is formed, so small standard
deviations keep their digits. What comes to the driver is d sums, one d x d triangle and a few figures, whatever the number of vectors.

Edge cases: a null vector, one with a null or non-finite entry, and one with an entry of 2 ** 44 or more in magnitude (its x would
not be exact as a double) are dropped. If vectors differ in length, those of the fit list's most common length stay (of several, the
greatest). Repeated rows each get their rows, and count once in the fit. Components without variance (an e below 1e-20 of the
greatest) can't be scaled and are left out, so equal vectors, a single one, or an empty table give no rows. A deviation that no
64-bit integer holds is null. Null ids are kept; columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import saved, table

SCALE = 256
COMPONENTS = 4
#: Rows of a block, and triangles that one task stacks.
BLOCK, FAN = 4096, 16
#: Entries of this magnitude or more have no exact x.
_HUGE = float(1 << 44)
#: Squared lengths from which a deviation may not fit a 64-bit integer.
_MOST = 9.2e18


class Whitening(NamedTuple):
    """n, the exact sums, components as columns, their eigenvalues (falling), the covariance's trace, and the largest error of the whitened covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def whole(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose entries are all there and finite, all their x in a row, and the rows' lengths."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lists)), size)
    good = lists.is_valid().to_numpy(zero_copy_only=False)
    good[row[~(np.abs(flat) < _HUGE)]] = False  # NaN, a null entry too, compares as false
    rows = np.flatnonzero(good)
    return rows, np.floor(SCALE * flat[good[row]]).astype(np.int64), size[rows]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, x, size = whole(batch.column(0))
        bounds = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int64)
        yield pa.record_batch([pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(x)]).cast(pa.binary())], ["x"])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """The rows of a batch of the fit list."""
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, d)


def _sums(d: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(d, object), 0
        for batch in batches:
            x = _matrix(batch, d)
            total, n = total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.record_batch([pa.array(np.arange(d), pa.int32()), pa.array([str(v) for v in total]), pa.array(np.full(d, n))], ["position", "total", "n"])

    return summed


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows' QR decomposition."""
    return np.linalg.qr(rows, mode="r")


def _block_qr(d: int, mean: np.ndarray):
    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                r = triangle(np.concatenate([r, _matrix(batch.slice(at, BLOCK), d) - mean]))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return reduced


def _stacked(d: int):
    def stack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        r = triangle(np.concatenate([np.frombuffer(x, np.float64).reshape(-1, d) for x in rows.column("r").to_pylist()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    return stack


def tsqr(fit: DataFrame, d: int, mean: np.ndarray) -> np.ndarray:
    """The triangle R of the fit list's centred rows; as many rows as it needs."""
    rs = fit.mapInArrow(_block_qr(d, mean), "part long, r binary")
    parts = fit.rdd.getNumPartitions()
    while True:
        rs = rs.groupBy(F.expr(f"part div {FAN}").alias("up")).applyInArrow(_stacked(d), "part long, r binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            return np.frombuffer(rs.first()["r"], np.float64).reshape(-1, d)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r, by plane rotations of pairs of columns.

    A sweep meets every pair once, in rounds of disjoint pairs that turn together; it ends when all columns are orthogonal.
    """
    d = r.shape[1]
    a, v = np.array(r, np.float64, order="F"), np.eye(d, order="F")
    circle = np.arange(d + d % 2)  # with an odd number one column rests
    for _ in range(sweeps):
        turned = False
        for _ in range(len(circle) - 1):
            half = len(circle) // 2
            i, j = circle[:half], circle[half:][::-1]
            there = (i < d) & (j < d)
            i, j = i[there], j[there]
            x, y = a[:, i], a[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            open_ = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if open_.any():
                turned = True
                i, j, xx, yy, xy = i[open_], j[open_], xx[open_], yy[open_], xy[open_]
                with np.errstate(over="ignore"):  # a column of length 0 beside one that isn't: no turn
                    zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                for m in (a, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            circle = np.concatenate([circle[:1], circle[-1:], circle[1:-1]])
        if not turned:
            break
    length = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


def _products(d: int, mean: np.ndarray, turn: np.ndarray):
    """Sums of the whitened rows and of their products, a row each entry: (i, j, total); j = -1 for plain sums."""
    k = turn.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = (_matrix(batch, d) - mean) @ turn
            total, plain = total + w.T @ w, plain + w.sum(axis=0)
        i, j = np.divmod(np.arange(k * k), max(k, 1))
        columns = [np.concatenate([i, np.arange(k)]), np.concatenate([j, np.full(k, -1)]), np.concatenate([total.ravel(), plain])]
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2])], ["i", "j", "total"])

    return products


def fitted(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x of a column of vectors."""
    fit = saved(vectors.select(vector).mapInArrow(_packed, "x binary").distinct(), "fit")
    longest = fit.groupBy(F.octet_length("x").alias("bytes")).count().orderBy(F.desc("count"), F.desc("bytes")).first()
    d = longest["bytes"] // 8 if longest else 0
    if not d:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    fit = fit.where(F.octet_length("x") == 8 * d)
    sums = fit.mapInArrow(_sums(d), "position int, total string, n long").groupBy("position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    n = sums[0]["n"]
    total = np.zeros(d, object)
    for row in sums:
        total[row["position"]] = int(row["total"])
    mean = np.array([v / n for v in total], np.float64)
    lengths, turns = jacobi(tsqr(fit, d, mean))
    values = lengths**2 / n
    trace = float(values.sum())
    kept = values[:components] > 1e-20 * max(values[0], 1e-300)
    values, turns = values[:components][kept], turns[:, :components][:, kept]
    turns = turns * np.where(turns[np.argmax(np.abs(turns), axis=0), np.arange(turns.shape[1])] < 0, -1.0, 1.0)
    k, error = len(values), 0.0
    if k:
        met = fit.mapInArrow(_products(d, mean, turns / np.sqrt(values)), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
        found = {(row["i"], row["j"]): row["total"] / n for row in met}
        middle = np.array([found[i, -1] for i in range(k)])
        error = float(np.abs(np.array([[found[i, j] for j in range(k)] for i in range(k)]) - np.outer(middle, middle) - np.eye(k)).max())
    return Whitening(n, total, turns, values, trace, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum of (n * x - S)^2 of each row, exact; null where 64 bits don't hold it."""
    about = np.square(n * x.astype(np.float64) - sums.astype(np.float64)).sum(axis=1)
    low = np.array([(int(s) + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], np.int64)
    with np.errstate(over="ignore"):
        exact = np.square(x * np.int64(n) - low).sum(axis=1)  # modulo 2 ** 64, so exact where the result fits
    return pa.array(exact, mask=about >= _MOST)


def whitened(vectors: DataFrame, fit: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that isn't dropped and each component: key, component, n, deviation, whitened, explained, identity_error."""
    d, k = len(fit.sums), len(fit.values)
    kind = vectors.schema[key].dataType.simpleString()
    mean = np.array([v / fit.n for v in fit.sums], np.float64)
    turn = fit.components / np.sqrt(fit.values)
    share = fit.values / fit.trace if k else np.zeros(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, size = whole(batch.column(1))
            same = size == d
            if not k or not same.any():
                continue
            x, at = x[np.repeat(same, size)].reshape(-1, d), at[same]
            m = len(at)
            found = (x - mean) @ turn
            columns = [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, fit.n)), _deviations(x, fit.n, fit.sums).take(pa.array(np.repeat(np.arange(m), k))), pa.array(found.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, fit.error))]
            yield pa.record_batch(columns, ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = vectors.select(key, vector).mapInArrow(rows, f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitened(vectors, fitted(vectors))

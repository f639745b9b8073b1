"""Work that must not grow with the number of blocks, or of settled rows, beside it."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import neardup, shared, windows


def fed(anchors, blocks, seed=1):
    """Rows of a bucket as that many blocks send them."""
    rng = np.random.default_rng(seed)
    each = np.array_split(rng.integers(0, 2 * anchors, anchors), blocks)
    rows = []
    for b, values in enumerate(each):
        values = np.unique(values).astype(np.uint64)
        rows.append((b, windows._packed(values).tobytes(), np.packbits(rng.random(len(values)) < 0.1).tobytes(), rng.integers(0, 30, len(values)).astype(np.uint8).tobytes()))
    return pa.table({k: pa.array([r[i] for r in rows], pa.int32() if not i else pa.binary()) for i, k in enumerate(("block", "low", "twice", "level"))})


def test_shared_anchors_equal_a_plain_count():
    rows, bound = fed(3_000, 37), 12.0
    holders, load, double = {}, {}, set()
    for row in rows.to_pylist():
        values = windows._unpacked(row["low"]).tolist()
        twice = np.unpackbits(np.frombuffer(row["twice"], np.uint8), count=len(values))
        for v, t, level in zip(values, twice, row["level"], strict=True):
            holders.setdefault(v, []).append(row["block"])
            load[v] = load.get(v, 0) + 2 ** (level / 8)
            if t:
                double.add((row["block"], v))
    want = {}
    for v, blocks in holders.items():
        for b in blocks:
            if len(blocks) > 1 or (b, v) in double:
                want.setdefault(b, []).append(v)
    got = windows.shared_anchors(rows, 5, bound)
    assert got.column("bucket").unique().to_pylist() == [5]
    assert {r["block"]: windows._unpacked(r["anchors"]).tolist() for r in got.to_pylist()} == {b: sorted(v) for b, v in want.items()}
    assert {r["block"]: windows._unpacked(r["heavy"]).tolist() for r in got.to_pylist()} == {b: sorted(x for x in v if load[x] > bound) for b, v in want.items()}


def quickest(work):
    times = []
    for _ in range(3):
        began = time.process_time()
        work()
        times.append(time.process_time() - began)
    return min(times)


def test_a_bucket_of_many_blocks_takes_as_long_as_one_of_few():
    few, many = (quickest(lambda rows=fed(600_000, n): windows.shared_anchors(rows, 0, 100)) for n in (1_000, 16_000))
    assert many < 2 * few + 0.2 and many < 2


def test_runs_of_many_blocks_take_as_long_as_those_of_few():
    n = 600_000
    keys, hooks, order = np.arange(2 * n, dtype=np.uint64).reshape(-1, 2), np.zeros(n, np.uint64), np.arange(n)
    few, many = (quickest(lambda b=b: windows.runs(np.sort(order % b), keys, hooks, order, order * 0, order)) for b in (1_000, 16_000))
    assert many < 3 * few + 0.3 and many < 2


@pytest.mark.parametrize(("settled", "apart"), [(5_000, 1), (400, 3)])
def test_settled_rows_are_sent_once_for_each_part_of_the_rest(spark, settled, apart):
    rows = [("g", k, "big", 100) for k in range(settled)] + [("g", settled + k, f"other{k}", 100) for k in range(apart)] + [("whole", k, "one", 100) for k in range(50)]
    placed = spark.createDataFrame(rows, "group string, node long, component string, n_shingles long")
    cells = neardup._cells(placed, 5_000).collect()
    assert {r["group"] for r in cells} == {"g"}
    assert len(cells) <= settled + apart * (1 + settled // 50 + apart) <= 2 * settled
    met = {}
    for r in cells:
        met.setdefault((r["kind"], r["low"], r["high"]), []).append((r["node"], r["component"]))
    pairs = {(min(a, b), max(a, b)) for rows in met.values() for a, x in rows for b, y in rows if x != y and (x != "big" or y != "big")}
    assert pairs == {(a, b) for b in range(settled, settled + apart) for a in range(b)}


def test_pairs_of_the_rest_meet_in_some_cell(spark):
    placed = spark.createDataFrame([("g", k, f"c{k // 3}", 100) for k in range(90)], "group string, node long, component string, n_shingles long")
    met = {}
    for r in neardup._cells(placed, 700).collect():
        met.setdefault((r["kind"], r["low"], r["high"]), []).append(r["node"])
    assert {(a, b) for rows in met.values() for a in rows for b in rows if a // 3 < b // 3} == {(a, b) for a in range(90) for b in range(90) if a // 3 < b // 3}
    assert max(map(len, met.values())) < 30


def test_rows_without_a_key_stay_apart(spark):
    rows = spark.createDataFrame([(k, None if k % 2 else f"k{k % 4}") for k in range(4_000)], "id long, key string")
    once = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("times")).withColumn("value", F.concat("key", F.lit("!")))
    df = shared.with_once(rows, once, "key")
    assert sorted((r["id"], r["key"], r["value"]) for r in df.collect()) == [(k, None if k % 2 else f"k{k % 4}", None if k % 2 else f"k{k % 4}!") for k in range(4_000)]

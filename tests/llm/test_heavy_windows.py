"""One passage in many documents of different context: no shard gets all that surrounds it, and the rows stay right."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import fmindex, shared, suffixes, windows
from tests.llm import test_fmindex, test_suffixes


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    passage = text(60)
    rows = [(k, " ".join(text(rng.randint(20, 60)) + passage + text(rng.randint(20, 60)))) for k in range(300)]
    near = rows[7][1].split()
    return rows + [(k, " ".join(text(10) + near[5:100] + text(10))) for k in range(300, 306)] + [(400, rows[3][1]), (401, " ".join(passage * 3)), (None, " ".join(near[:70]))]


CASES = [(fmindex, fmindex.op7_fmindex, test_fmindex.brute, (35, 18, 9000), False), (suffixes, suffixes.op10_suffixes, test_suffixes.brute, (50, 24, 9000), True)]


@pytest.mark.parametrize(("module", "query", "brute", "defaults", "ordered"), CASES)
def test_common_passage(spark, tmp_path, monkeypatch, module, query, brute, defaults, ordered):
    monkeypatch.setattr(windows, "HEAVY", 1000, raising=False)
    depth, gram, size = defaults
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(module.planned, "__defaults__", defaults)
    got = query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, depth)

    kept = []
    sent = windows.sent_segments
    monkeypatch.setattr(windows, "sent_segments", lambda *a: kept.append(sent(*a)) or kept[-1])
    module.planned(docs)
    shards = [r[0] for r in kept[0].groupBy("shard").agg(F.sum(F.octet_length("sizes") / 8)).select(F.col("sum((octet_length(sizes) / 8))")).collect()]
    assert len(shards) > 10 and max(shards) < 3 * sum(shards) / len(shards)


@pytest.mark.parametrize(("module", "query", "brute", "defaults", "ordered"), CASES)
def test_many_blocks_share_few_parts(spark, tmp_path, monkeypatch, module, query, brute, defaults, ordered):
    monkeypatch.setattr(windows, "PARTS", 3)
    depth, gram, _ = defaults
    rows = corpus()[:120]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(module.planned, "__defaults__", (depth, gram, 400))
    got = query(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, depth)


def test_the_number_of_buckets_is_bounded(spark, monkeypatch):
    """More blocks than Spark allows buckets: the table has PARTS of them, and only blocks with text have rows."""
    docs = spark.createDataFrame([(k, f"text {k} " * 3000) for k in range(40)], "doc_id long, text string")
    monkeypatch.setattr(windows, "PARTS", 5)
    blocked = windows.blocks(docs, 8)
    assert blocked.n > 100_000 and blocked.parts == 5 and blocked.table.select("block").distinct().count() == 40
    anchors = windows.repeated_anchors(blocked, fmindex._tokens(18), 35, 18, True)
    assert anchors.select("block").distinct().count() == 40
    blocked.drop()


def test_keys_of_two_numbers():
    keys = np.array([[5, 1], [3, 9], [5, 2], [5, 1], [3, 9]], np.uint64)
    ids = windows.ranked(keys)
    assert len({*ids.tolist()}) == 3 and ids[0] == ids[3] != ids[2] and ids[1] == ids[4]
    assert sorted(windows._firsts(keys, np.array([4, 2, 9, 3, 1])).tolist()) == [2, 3, 4]


def test_rows_of_common_keys_are_joined(spark, monkeypatch):
    monkeypatch.setattr(shared, "HEAVY", 2)
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "a").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("digest"))
    once = rows.groupBy("digest").agg(F.count("*").alias("times"), F.max("id").alias("most"))
    got = shared.with_once(rows, once, "digest")
    assert got.columns == ["id", "digest", "most"] and got.count() == 5000 and got.where("most is null").count() == 0
    assert got.where("digest = 'a' and most <> 3999").count() == 0

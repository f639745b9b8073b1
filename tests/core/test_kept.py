"""Global ranks, pages by key, lists with counts, centroids kept up to date, and the harvest as a stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import centroid_state, listing, tables
from corvane.sources import harvest_stream, records


def test_places_by_ranges_equal_one_order(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("čćcdđsšzž") * rng.randint(1, 3)) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, name string").repartition(5)
    order = [F.expr("name collate hr"), F.col("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    got = tables.placed(df, order, 6)
    assert [(r["id"], r["place"]) for r in got.orderBy("place").collect()] == list(zip(want, range(1, 701), strict=True))
    assert tables.placed(df.limit(0), order, 3).count() == 0


def test_no_task_ranks_all_rows(spark):
    kept = []
    original = tables.saved
    try:
        tables.saved = lambda df: kept.append(df) or original(df)
        tables.placed(spark.range(20_000).withColumn("x", F.rand(1)), [F.col("x"), F.col("id")], 10)
    finally:
        tables.saved = original
    sizes = [r["n"] for r in kept[0].groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 4_000


def test_pages_by_key(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 5)) for k in range(90)]
    df, order = spark.createDataFrame(rows, "id long, n int"), [("n", True), ("id", False)]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    seen, last = [], want[0]
    while len(seen) < 89:
        page = [tuple(r) for r in tables.after(df, order, [last[1], last[0]], 7).collect()]
        seen += page
        last = page[-1]
    assert seen == want[1:] and tables.after(df, order, [last[1], last[0]]).count() == 0
    with pytest.raises(ValueError, match="limit"):
        tables.after(df, order, [1, 1], 0)


def test_listing_counts(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", "c", None]), rng.sample(["x", "y", "z"], rng.randint(0, 3)), rng.randint(0, 9)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, unit string, tags array<string>, n int")
    filters = {"unit": (F.col("unit") == "a", F.col("unit")), "tag": (F.array_contains("tags", "x"), F.col("tags"))}
    found = listing.listed(df, filters, [F.desc("n"), F.col("id")], 20, 10, F.col("n") > 2)
    some = [r for r in rows if r[3] > 2]
    both = sorted((r for r in some if r[1] == "a" and "x" in r[2]), key=lambda r: (-r[3], r[0]))
    assert [(r["id"], r["place"]) for r in found.page.orderBy("place").collect()] == [(r[0], 11 + k) for k, r in enumerate(both[10:30])]
    want = {(None, None): len(both)}
    for r in some:
        if "x" in r[2] and r[1]:
            want["unit", r[1]] = want.get(("unit", r[1]), 0) + 1
        for t in r[2] if r[1] == "a" else []:
            want["tag", t] = want.get(("tag", t), 0) + 1
    assert {(r["facet"], r["value"]): r["n"] for r in found.counts.collect()} == want
    plain = listing.listed(df, {}, [F.col("id")], 5)
    assert plain.page.count() == 5 and [tuple(r) for r in plain.counts.collect()] == [(None, None, 300)]


def test_centroids_after_ten_batches_equal_those_of_one(spark):
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(3)]
    schema = "item_id long, group_id long, vector array<double>"
    now, state = {}, centroid_state.sums(spark.createDataFrame([], schema))
    for _ in range(10):
        batch = {rng.randint(0, 30): (rng.randint(0, 3), vector()) for _ in range(8)}
        stored = spark.createDataFrame([(k, *v) for k, v in now.items()], schema)
        state = centroid_state.upserted(state, stored, spark.createDataFrame([(k, *v) for k, v in batch.items()], schema))
        now |= batch
        gone = rng.sample(sorted(now), min(2, len(now)))
        state = centroid_state.changed(state, stored.limit(0), spark.createDataFrame([(k, *now.pop(k)) for k in gone], schema))
        state = spark.createDataFrame(state.collect(), state.schema)  # the table of the day
    once = centroid_state.sums(spark.createDataFrame([(k, *v) for k, v in now.items()], schema))
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in once.collect()}
    for r in centroid_state.centroids(state).collect():
        own = [v for g, v in now.values() if g == r["group_id"]]
        assert r["n"] == len(own) and r["centroid"] == pytest.approx([sum(x) / len(own) for x in zip(*own, strict=True)], abs=1e-6)


def test_harvest_goes_on_after_a_crash(spark, tmp_path):
    folder, asked = str(tmp_path), f"{tmp_path}/asked"
    record = lambda n: f'<record><header><identifier>r{n}</identifier></header><metadata><mods ID="m"><titleInfo lang="hrv"><title>T{n}</title></titleInfo></mods></metadata></record>'
    for k, (token, following) in enumerate([("", "a"), ("a", "b"), ("b", "")]):
        (tmp_path / f"source_{token}").write_text(f"<list>{record(2 * k)}{record(2 * k + 1)}<resumptionToken>{following}</resumptionToken></list>")

    def fetch(token):
        import pathlib

        with open(asked, "a") as out:
            out.write(f"{token}\n")
        if token == "b" and not pathlib.Path(f"{folder}/mended").exists():
            raise ConnectionError("no answer")
        return pathlib.Path(f"{folder}/source_{token or ''}").read_text()

    name = harvest_stream.registered(spark, fetch)

    def harvested(pages):
        query = harvest_stream.landed(spark.readStream.format(name).load(), f"file://{folder}/landed", f"file://{folder}/checkpoint")
        until = time.time() + 90
        while time.time() < until and query.isActive and len(list((tmp_path / "landed").glob("batch_*/_SUCCESS"))) < pages:
            time.sleep(0.2)
        return query

    query = harvested(3)
    with pytest.raises(Exception, match="(?s)no answer"):
        query.processAllAvailable()
    query.stop()
    assert records.scan(spark, f"{folder}/landed/*").count() == 4
    before = (tmp_path / "asked").read_text().split()
    (tmp_path / "mended").touch()
    query = harvested(3)
    query.stop()
    assert sorted(r["identifier"] for r in records.items(records.scan(spark, f"{folder}/landed/*")).collect()) == [f"r{k}" for k in range(6)]
    assert "None" not in (tmp_path / "asked").read_text().split()[len(before) :]

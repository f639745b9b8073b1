"""Cases at the edge: null ids, repeated rows, columns with the operators' own names, empty tables."""

import corpus_pipeline
from corvane.llm import licenses, media, pieces
from corvane.llm.shared import saved

NOTICE = next(iter(licenses.TEMPLATES.values()))


def test_licenses_of_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, NOTICE), (1, NOTICE), (1, NOTICE), (2, None)], "doc_id long, text string")
    rows = licenses.scanned(docs).collect()
    assert {r["doc_id"] for r in rows} == {None, 1} and all(r["containment"] > 0 for r in rows)
    assert len({r["license"] for r in rows if r["doc_id"] is None}) == len({r["license"] for r in rows if r["doc_id"] == 1})


def test_media_of_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y", 5, 6), (None, "a", "x", "y", 5, 6), (1, "a", "z", "y", 5, 6), (2, None, "x", "y", 5, 6)], "doc_id long, text string, digest string, shard string, offset int, length int")
    index, folder = media.stored(docs)
    found = media.canonical(media.described(media.with_metadata(index, folder), folder)).collect()
    assert len(found) == 2
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in media.digests(docs).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]


def test_pieces_of_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    tokens = saved(pieces.encoded(docs))
    rows = tokens.collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 2]
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] != 2}) == 1
    assert sorted(r["text"] for r in pieces.decoded(tokens).collect()) == ["", "one two", "one two", "one two"]


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = saved(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns

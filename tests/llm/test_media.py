import hashlib
import io
import tarfile
import zlib

from pyarrow import fs

from corvane.llm import media

TEXTS = ["abc", "", None, "abc", "x" * 64, "é" * 100000, "y" * 63, "\0\0"]


def test_store_and_read_back(spark):
    docs = spark.createDataFrame([(k, t, "d") for k, t in enumerate(TEXTS)], "doc_id long, text string, digest string")
    index, folder = media.stored(docs)
    meta = media.canonical(media.with_metadata(index, folder)).collect()
    assert len(meta) == len({media.payload((t or "").encode()) for t in TEXTS})
    assert all(r["width"] == 64 and r["bits"] == 8 for r in meta)
    found = {r["digest"]: r for r in media.canonical(media.described(index, folder)).collect()}
    for r in media.digests(docs).collect():
        data = media.payload((TEXTS[r["doc_id"]] or "").encode())
        x = found[r["digest"]]
        assert r["n_bytes"] == len((TEXTS[r["doc_id"]] or "").encode()) and x["payload_bytes"] == len(data) and len(data) % 64 == 0
        assert x["payload_sha256"] == r["digest"] == hashlib.sha256(data).hexdigest()
        assert x["tail_crc32"] == zlib.crc32(data[-64:])
        assert x["media_sha256"] == hashlib.sha256(media.image(data)).hexdigest() and media.samples(media.image(data)) == data
    store, root = fs.FileSystem.from_uri(folder)
    members = set()
    for f in store.get_file_info(fs.FileSelector(root)):
        with tarfile.open(fileobj=io.BytesIO(store.open_input_file(f.path).read())) as tar:
            for m in tar.getmembers():
                assert m.name == f"{hashlib.sha256(media.samples(tar.extractfile(m).read())).hexdigest()}.png"
                members.add(m.name)
    assert len(members) == len(meta)


def test_empty_table(spark):
    index, folder = media.stored(spark.createDataFrame([], "doc_id long, text string"))
    assert media.described(media.with_metadata(index, folder), folder).count() == 0


def test_query(spark, sf_dir):
    rows = media.op3_media(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert r["payload_sha256"] == hashlib.sha256(media.payload(texts[r["doc_id"]].encode())).hexdigest()


def feature(data):
    mean = sum(data) / len(data)
    spread = (sum((x - mean) ** 2 for x in data) / len(data)) ** 0.5
    edges = sum(abs(a - b) for a, b in zip(data, data[1:])) / (len(data) - 1)
    return [mean, spread, edges, *[sum(x // 16 == k for x in data) * 1000 // len(data) for k in range(16)]]


def test_features_nulls_and_repeats(spark, tmp_path):
    rows = [(None, "a"), (None, "a"), (1, "a"), (1, None), (2, "longer than sixty-four bytes, as texts go, so that it takes two lines é"), (3, "z" * 3_000_000)]
    spark.createDataFrame(rows * 3, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op3_media(spark, str(tmp_path)).collect()
    assert len(got) == 18 and sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == sorted([(k or 0, len((t or "").encode())) for k, t in rows] * 3)
    want = {hashlib.sha256(media.payload((t or "").encode())).hexdigest(): feature(media.payload((t or "").encode())) for _, t in rows[:5]}
    for r in got:
        if r["payload_sha256"] in want:
            assert all(abs(float(a) - b) < 6e-4 for a, b in zip(r["feature"].split(","), want[r["payload_sha256"]], strict=True))

"""Media columns: texts as 8-bit grey images, content-addressed in tar shards.

A payload (the UTF-8 bytes, zero-padded to a positive multiple of 64) is stored as a PNG of 64 samples a line, which is
lossless. Equal payloads have one name, the digest of the payload, and are stored once by a task; where several tasks have written
one, their images are equal, and every reference is to the first of them, so no image is ever shuffled. A task writes its
images to tar files in the shared folder; a row carries digest, shard, offset and length. Header-only range reads (33 bytes of
each image) fill the metadata columns; the stored bytes are read back by range, decoded and described by features.

A shard's name has the task attempt's id, so a task that runs again writes another file, and only the file of the
attempt whose rows were kept is referred to. Payloads go through no driver; a task holds one image at a time.

Edge cases: null text counts as empty (64 zero bytes); equal texts share all values; texts of any length are one image;
repeated rows each get a row; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import saved, scratch, table, with_once

WIDTH = 64
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG that hold its signature and header.
HEADER = 33
#: Bytes of images that a task reads back.
READ = 16 << 20
#: Bytes of tar shard that one task aims at.
SHARD = 64 << 20


def payload(text: bytes) -> bytes:
    """text with zero bytes up to a positive multiple of 64."""
    return text + bytes(WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(data: bytes) -> bytes:
    """A grey PNG, 8 bits a sample, 64 samples a line, of a payload."""
    lines = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(data) // WIDTH, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int]:
    """Width and height from an image's first bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    return struct.unpack(">II", data[16:24])


def samples(data: bytes) -> bytes:
    """The payload of an image."""
    width, height = header(data)
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def features(data: bytes) -> str:
    """Mean, deviation, edge strength and the histogram in 16 bins (per mille) of a payload's samples."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    edges = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    return f"{x.mean():.3f},{x.std():.3f},{edges:.3f}," + ",".join(map(str, bins))


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put the image of each payload that this task hasn't met yet into a shard."""
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                data = payload(text.as_py() or b"")
                digest = hashlib.sha256(data)
                if digest.digest() in seen:
                    continue
                seen.add(digest.digest())
                data = image(data)
                if out is None or at > SHARD:
                    if out is not None:
                        out.write(bytes(1024))
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.tar", 0
                    out = store.open_output_stream(f"{root}/{name}")
                entry = tarfile.TarInfo(f"{digest.hexdigest()}.png")
                entry.size = len(data)
                head = entry.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + data + bytes(-len(data) % 512))
                rows.append((digest.hexdigest(), name, at + len(head), len(data)))
                at += len(head) + len(data) + -len(data) % 512
            if rows:
                yield pa.record_batch(list(map(pa.array, zip(*rows, strict=True))), ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    return write


def stored(docs: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write the payloads of docs; a row (digest, shard, offset, length) for each image written, and the folder of the shards."""
    spark = docs.sparkSession
    folder = folder or f"{scratch(spark)}/media"
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return saved(texts.mapInArrow(_writer(folder), "digest string, shard string, offset long, length long"), "index"), folder


def canonical(index: DataFrame) -> DataFrame:
    """One row for each digest: of an image that several tasks have written, the first by shard and offset."""
    rest = [c for c in index.columns if c not in ("digest", "shard", "offset")]
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", *rest)).alias("_x")).select("digest", *[F.col(f"_x.{c}").alias(c) for c in index.columns if c != "digest"])


def _ranges(folder: str, batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with each row's stored bytes (or the first size of them), read by range; one shard is open at a time."""
    store, root = fs.FileSystem.from_uri(folder)
    name, file = "", None
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            found = []
            for shard, offset, length in zip(*[part.column(c).to_pylist() for c in ("shard", "offset", "length")], strict=True):
                if shard != name:
                    name, file = shard, store.open_input_file(f"{root}/{shard}")
                file.seek(offset)
                found.append(file.read(min(length, size or length)))
            yield part, found


def dealt(index: DataFrame) -> DataFrame:
    """The rows of index by place, in as many parts as the images' bytes ask for: an index is small, what it refers to isn't."""
    total = index.agg(F.sum("length")).first()[0] or 0
    return index.repartitionByRange(int(total // READ) + 1, "shard", "offset").sortWithinPartitions("shard", "offset")


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """index with width, height and bits, from the images' headers alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, heads in _ranges(folder, batches, HEADER):
            sizes = [header(x) for x in heads]
            yield pa.record_batch([*part.columns, pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32()), pa.array([x[24] for x in heads], pa.int32())], [*part.schema.names, "width", "height", "bits"])

    return index.mapInArrow(read, "digest string, shard string, offset long, length long, width int, height int, bits int")


def described(index: DataFrame, folder: str) -> DataFrame:
    """What is stored under each digest: sizes and digests of both forms, checksum of the last 64 samples, features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, images in _ranges(folder, batches):
            rows = []
            for data in images:
                x = samples(data)
                rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(x)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.record_batch([*part.columns, *map(pa.array, zip(*rows, strict=True))], [*part.schema.names, *names])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema.fields)
    return index.mapInArrow(read, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the digest of the payload of every document."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    n = F.octet_length(text)
    padding = F.when((n == 0) | (n % WIDTH != 0), F.lit(WIDTH) - n % WIDTH).otherwise(0)
    zeros = F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), padding.cast("int"))
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), F.sha2(F.concat(text, zeros), 256).alias("digest"))


def op3_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index, folder = stored(docs)
    media = canonical(described(with_metadata(dealt(index), folder), folder))
    rows = saved(digests(docs), "digests")
    once = saved(media.join(rows.groupBy("digest").agg(F.count("*").alias("times")), "digest"), "media")
    return with_once(rows, once, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length")

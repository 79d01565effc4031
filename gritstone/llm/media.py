"""Media columns: payloads in tar shards, rows with digest, offset and length, metadata from header-only range reads.

A payload becomes a grey PNG, `WIDTH` samples of 8 bits wide, named by the SHA-256 of the payload. Each writing task
appends its payloads to shards of its own in the shared folder, each distinct payload once; the index keeps one place
for each digest of all shards, and every row is led there. The shards' rows are written to a table at once, so a task
that is run again cannot leave rows that point to a shard it did not finish.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import new_folder, prepare, staged

WIDTH = 192
#: A shard is closed once it has so many bytes.
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(body: bytes) -> bytes:
    """`body` with spaces appended up to a positive multiple of WIDTH."""
    return body + b" " * (max(WIDTH, -(-len(body) // WIDTH) * WIDTH) - len(body))


def encode(payload: bytes) -> bytes:
    """A grey 8-bit PNG of the payload's bytes, WIDTH to a row, without row filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER_BYTES of a PNG."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", start[16:25])


def decode(media: bytes) -> np.ndarray:
    """The samples, one row for each row of the image."""
    width, height, depth = header(media[:HEADER_BYTES])
    at, data = 8, b""
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data += body
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread, mean step along a row and entropy of the samples, as fixed-point text."""
    x = samples.astype(np.int64)
    n = x.size
    p = np.bincount(samples.ravel(), minlength=256) / n
    mean = x.sum() / n
    spread = max(0.0, (x * x).sum() / n - mean * mean) ** 0.5
    step = np.abs(np.diff(x, axis=1)).sum() / n
    return f"{samples.shape[1]}x{samples.shape[0]};mean={mean:.3f};spread={spread:.3f};step={step:.3f};entropy={-(p[p > 0] * np.log2(p[p > 0])).sum():.4f}"


class Shard:
    """One tar file, written front to back through any file system that a URI can name."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.uri = f"{folder}/{uuid.uuid4().hex}.tar"
        self.out = self.system.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}")
        self.at = 0

    def add(self, name: str, body: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        start = self.at + len(head)
        tail = b"\0" * (-len(body) % 512)
        self.out.write(head + body + tail)
        self.at = start + len(body) + len(tail)
        return start

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


class Reader:
    """Range reads, with the last few shards kept open."""

    def __init__(self, most: int = 16):
        self.open: dict = {}
        self.most = most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        from pyarrow import fs

        f = self.open.get(uri)
        if f is None:
            if len(self.open) >= self.most:
                self.open.pop(next(iter(self.open))).close()
            system, path = fs.FileSystem.from_uri(uri)
            f = self.open[uri] = system.open_input_file(path)
        return f.read_at(length, offset)


#: Media that one task reads, about.
TASK_MEDIA = 5000


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write every row's payload to shards: the rows (id_col, n_bytes, digest), and the index (digest, shard, offset,
    length) with one place for each digest.

    Null texts are empty and stored as one row of blanks, as blank texts are. Equal texts are led to one place, so ties and
    repeated rows share it. Null and repeated ids are kept. Very long texts are stored whole, as higher images; a shard ends
    behind the medium that fills it. Extra columns are ignored, whatever their names. An empty table makes no shards.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = new_folder(spark, "media")
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, {}
        try:
            for batch in batches:
                size, digests, shards, offsets, lengths = [], [], [], [], []
                for body in batch.column(1).to_pylist():
                    payload = pad(body or b"")
                    digest = hashlib.sha256(payload).hexdigest()
                    place = seen.get(digest)
                    if place is None:
                        if shard is None:
                            shard = Shard(folder)
                        media = encode(payload)
                        place = seen[digest] = (shard.uri, shard.add(f"{digest[:2]}/{digest}.png", media), len(media))
                        if shard.at >= shard_bytes:
                            shard.close()
                            shard, seen = None, {}
                    size.append(len(body or b""))
                    digests.append(digest)
                    shards.append(place[0])
                    offsets.append(place[1])
                    lengths.append(place[2])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(digests, pa.string()), pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if shard is not None:
                shard.close()

    placed = staged(docs.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(rows, f"id {kind}, n_bytes long, digest string, shard string, offset long, length long"), "media-index")
    index = staged(placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*"), "media-places")
    # narrow rows stand for large media, so they are dealt by number
    return placed.select(F.col("id").alias(id_col), "n_bytes", "digest"), index.repartition(max(8, index.count() // TASK_MEDIA))


def with_metadata(rows: DataFrame) -> DataFrame:
    """The index of store() with width, height and depth, from the first bytes of each medium only."""

    @F.pandas_udf("width long, height long, depth long")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for shards, offsets in parts:
            yield pd.DataFrame([header(reader.read(s, int(o), HEADER_BYTES)) for s, o in zip(shards, offsets)], columns=["width", "height", "depth"])

    return rows.withColumn("__m", look("shard", "offset")).select(*rows.columns, "__m.*")


READ_BACK = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(rows: DataFrame) -> DataFrame:
    """The index of store() with READ_BACK: each stored medium is read by its range, decoded and measured."""

    @F.pandas_udf(READ_BACK)
    def look(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for shards, offsets, lengths in parts:
            out = []
            for at in zip(shards, offsets, lengths):
                media = reader.read(at[0], int(at[1]), int(at[2]))
                samples = decode(media)
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ_BACK.split(", ")])

    near = rows.sortWithinPartitions("shard", "offset")
    return near.withColumn("__m", look("shard", "offset", "length")).select(*rows.columns, "__m.*")

"""Media columns: payloads as content-addressed grey-scale images in tar shards.

A payload becomes a PNG of 64 samples a row, 8 bits each, named by the payload's SHA-256 in a tar shard. Rows
carry digest, shard, offset and length. Metadata comes from range reads of the 33 header bytes, features from the
stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import saved, work_path
from .files import Ranges, Rolling, uri

WIDTH, HEADER_BYTES = 64, 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """payload, a positive multiple of 64 bytes, as an image; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def header_of(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not an image header")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image of to_png."""
    width, height, _ = header_of(media[:HEADER_BYTES])
    at, data = HEADER_BYTES, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(media[at + 4 : at + 8 + n]):
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length of every row, after its payload has been written to the folder.

    A task writes a payload once; of the copies that several tasks write, `locations` keeps one. Null and empty texts
    are 64 zero bytes; an empty table writes nothing. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Rolling(folder, f"shard-{TaskContext.get().partitionId():06d}", ".tar", shard_bytes)
        kept: dict[str, tuple[str, int, int]] = {}
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in kept:
                        media = to_png(payload)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        name, at = shard.write(head + media + bytes(-len(media) % 512))
                        if len(kept) > 200_000:
                            kept.clear()
                        kept[digest] = (name, at + len(head), len(media))
                        if shard.full():
                            shard.close(bytes(1024))
                    out.append((doc_id, n, digest, *kept[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shard.close(bytes(1024))

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    return saved(rows, "media-index")


def locations(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place of every payload."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height and bits, from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            heads = [header_of(files.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            columns = [pa.array([h[k] for h in heads], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])

    return places.sortWithinPartitions("shard", "offset").mapInArrow(run, "digest string, shard string, offset long, length long, width long, height long, bits long")


def features(places: DataFrame, folder: str) -> DataFrame:
    """digest and what the stored bytes give: sizes, digests, the checksum of the last 64 samples and a feature string
    (image size, sample sum and sum of squares, sum of samples by place, and the means of 16 equal parts in turn)."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                out = []
                for digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                    media = files.read(shard, offset, length)
                    width, height, bits = header_of(media[:HEADER_BYTES])
                    payload = from_png(media)
                    own = hashlib.sha256(payload).hexdigest()
                    if own != digest:
                        raise ValueError(f"{shard} at {offset} does not hold {digest}")
                    samples = np.frombuffer(payload, np.uint8).astype(np.uint64)
                    placed = int((samples * np.arange(1, len(samples) + 1, dtype=np.uint64)).sum())
                    means = "".join(f"{int(part.sum()) // len(part):02x}" for part in np.array_split(samples, 16))
                    feature = f"png:{width}x{height}x{bits}:{int(samples.sum())}:{int((samples * samples).sum())}:{placed}:{means}"
                    out.append((digest, len(payload), own, zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    chosen = places.select("digest", "shard", "offset", "length").sortWithinPartitions("shard", "offset")
    return chosen.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of every row with the features of its stored payload and the metadata columns of its header.

    shard, offset and length say where the payload stands. Equal texts share one payload and so all values but the id.
    Repeated rows come back as often as they stand; null and empty texts are 64 zero bytes; an empty table gives no rows.
    """
    where = uri(folder or work_path(docs.sparkSession, "media"))
    index = store(docs, where, id_col, text_col)
    places = saved(locations(index), "places")
    told = features(places, where).join(metadata(places, where).drop("bits"), "digest")
    told = saved(told, "features")
    return index.drop("shard", "offset", "length").join(told, "digest")

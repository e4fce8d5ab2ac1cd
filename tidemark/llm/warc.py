"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by id, each range is written to gzip files that roll by compressed size, under temporary names
until complete; the manifest, a table with a row for each file, is what commits them. Ranges come from exact sums of
bytes over id intervals, headers and digests are made anew from the payloads, so equal tables give equal files of equal
names, however their rows are dealt.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import forget, saved, work_path
from .files import Ranges, Rolling, uri

DATE = "2024-01-01T00:00:00Z"


def planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """id, url, html, digest, refers_to. Of payloads of least_bytes or more that are equal, the largest id is the response."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digest = F.when(F.octet_length("html") >= least_bytes, F.sha1(F.col("html").cast("binary")))
    ids = rows.select("id", digest.alias("digest")).filter("digest is not null")
    copies = ids.groupBy("digest").agg(F.max("id").alias("last"), F.min("id").alias("first")).filter("first < last").select("digest", "last")
    revisits = saved(ids.join(copies, "digest").filter("id < last").select("id", "digest", F.col("last").alias("refers_to")).distinct(), "revisits")
    if revisits.count() <= 200_000:  # about 15 MB; beyond, by a shuffle
        revisits = F.broadcast(revisits)
    return rows.withColumn("digest", digest).join(revisits, ["id", "digest"], "left")


def weighed_ranges(sizes: DataFrame, target_bytes: int, parts: int = 1024, most_parts: int = 1_000_000) -> list[tuple[int, int]]:
    """(first id, shares) of ranges of about target_bytes each, from rows (id, bytes).

    Bytes are summed over equal intervals of the ids, four for each range; all intervals that are too heavy, as where
    ids are not even, are cut again, into as many as their bytes want and `parts` in all at least, in one pass a round.
    An id that is too heavy by itself is a range of its own, to be dealt to as many shares as its bytes want. The driver
    sees sums of intervals that hold rows only, a few for each range."""
    told = sizes.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("bytes").alias("bytes")).first()
    if told.lo is None:
        return []
    todo, weights = [(told.lo, told.hi, told.bytes)], {}
    while todo:
        least = max(8, parts // len(todo))
        widths = [max(1, -(-(hi - lo + 1) // min(most_parts, max(least, 4 * own // target_bytes)))) for lo, hi, own in todo]
        cuts = sizes.withColumn("i", _interval_of([x[:2] for x in todo], widths)("id")).filter("i.first is not null")
        found = cuts.groupBy("i").agg(F.sum("bytes").alias("bytes")).select("i.*", "bytes").collect()
        heavy = [r for r in found if r.bytes > 2 * target_bytes and r.width > 1]
        again = {r.first for r in heavy}
        weights |= {r.first: r.bytes for r in found if r.first not in again}
        ends = [hi for _, hi, _ in todo]
        todo = sorted((r.first, min(r.first + r.width - 1, ends[bisect_left(ends, r.first)]), r.bytes) for r in heavy)
    ranges, held = [], target_bytes
    for first in sorted(weights):
        own = weights[first]
        if held >= target_bytes or own > 2 * target_bytes:
            ranges.append((first, own // target_bytes if own > 2 * target_bytes else 1))
            held = 0
        held += own
    return ranges


def id_ranges(sizes: DataFrame, target_bytes: int) -> list[int]:
    """The first ids of `weighed_ranges`."""
    return [first for first, _ in weighed_ranges(sizes, target_bytes)]


def _interval_of(spans: list[tuple[int, int]], widths: list[int]):
    """first and width of the interval that an id is in, among spans (lo, hi) in order that are cut by these widths;
    nulls outside."""
    lows, highs = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    steps = np.array([min(w, 2**63 - 1) for w in widths], np.uint64)

    @F.pandas_udf("first long, width long")
    def find(ids: pd.Series) -> pd.DataFrame:
        own = ids.to_numpy("int64")
        at = np.maximum(np.searchsorted(lows, own, "right") - 1, 0)
        width = steps[at]
        places = (own.view(np.uint64) - lows[at].view(np.uint64)) // width * width  # whole ids are 64 bits apart at most
        outside = pd.Series((own < lows[at]) | (own > highs[at]))
        out = {"first": (lows[at].view(np.uint64) + places).view(np.int64), "width": width.astype(np.int64)}
        return pd.DataFrame({k: pd.Series(v).astype("Int64").mask(outside) for k, v in out.items()})

    return find


def _record(kind: str, page: int | None, url: str, payload: bytes, digest: bytes, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    b32 = lambda d: base64.b32encode(d).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {url}"] if url else []
    lines += [f"WARC-Payload-Digest: sha1:{b32(digest)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush()


def _range_of(firsts: list[int]):
    """The range of an id among ranges of these first ids; null ids are in the first."""
    bounds = np.array(firsts, np.int64)

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(bounds, ids.fillna(bounds[0]).astype("int64").to_numpy(), "right") - 1, 0)
        return pd.Series(at.astype("int32"))

    return find


def _looked_up(values: np.ndarray):
    """What stands in values at the place that a column says."""

    @F.pandas_udf("long")
    def find(places: pd.Series) -> pd.Series:
        return pd.Series(values[places.to_numpy("int64")])

    return find


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, file_bytes: int = 32 << 20, level: int = 5, range_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for every row; returns the manifest: file, bytes, records.

    A null payload is empty, a null or empty url gives no target line (line ends in urls become spaces), a null id an empty record id.
    Repeated rows are records of their own. Rows of null ids, or of one id, that are too many for a range are dealt by
    hashes of url and payload to several (equal rows, which are one response and revisits of few bytes each, stay together); very long
    payloads are a record each as any others. An empty table gives an empty manifest. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, of, records = None, None, 0

        def ended() -> pa.RecordBatch:
            size = out.size
            return pa.RecordBatch.from_arrays([pa.array([out.close()]), pa.array([size]), pa.array([records])], names=["file", "bytes", "records"])

        for batch in batches:
            for lo in range(0, len(batch), 200):
                for page, url, html, refers, *part in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns), strict=True):
                    if part != of:
                        if out is not None and out.out is not None:
                            yield ended()
                        out, of, records = Rolling(folder, "part-{:06d}-{:04d}".format(*part), ".warc.gz", file_bytes, False), part, 0
                    payload = html.encode()
                    kind = "revisit" if refers is not None and len(payload) >= least_bytes else "response"
                    out.write(_member(_record(kind, page, " ".join((url or "").split()), payload, hashlib.sha1(payload).digest(), refers), level))
                    records += 1
                    if out.full():
                        yield ended()
                        records = 0
        if out is not None and out.out is not None:
            yield ended()

    rows = planned(pages, id_col, url_col, html_col, least_bytes)
    sizes = saved(rows.select("id", F.octet_length("html").cast("long").alias("bytes")), "sizes")
    ranges = weighed_ranges(sizes.filter("id is not null"), range_bytes) or [(0, 1)]
    nulls = max(1, (sizes.filter("id is null").agg(F.sum("bytes")).first()[0] or 0) // range_bytes)
    forget(sizes)
    part = _range_of([first for first, _ in ranges])(F.col("id"))
    rows = rows.withColumn("part", F.when(F.col("id").isNotNull(), part + 1).otherwise(F.lit(0)))  # null ids go first
    counts = np.array([nulls, *(k for _, k in ranges)], np.int64)  # of shares, more than one of too many records of one id, or of none
    share = F.lit(0)
    if counts.max() > 1:
        share = F.pmod(F.xxhash64("url", "html"), _looked_up(counts)(F.col("part"))).cast("int")
    tasks = min(int(counts.sum()), 20_000)
    task = _looked_up(np.cumsum(counts) - counts)(F.col("part")) + F.col("share")  # one range or share a task, or evenly more
    ranged = rows.withColumn("share", share).repartitionById(tasks, (task % tasks).cast("int")).sortWithinPartitions("part", "share", "id", "url", "html")
    return saved(ranged.select("id", "url", "html", "refers_to", "part", "share").mapInArrow(run, "file string, bytes long, records long"), "manifest")


def _page(urn: str) -> int | None:
    own = urn.strip("<>").removeprefix("urn:page:")
    return int(own) if own else None


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of all records of the manifest's files.

    Digests of blocks and payloads are computed again from what was read; a difference, or a file that has not the
    size or records of its manifest row, ends the job."""
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Ranges(folder)
        for batch in batches:
            for name, size, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = files.read(name, 0, size + 1)
                if len(raw) != size:
                    raise ValueError(f"{name} has not {size} bytes")
                seen, out = 0, []
                at = 0
                while at < size:
                    unpack = zlib.decompressobj(31)
                    record = unpack.decompress(raw[at : at + (1 << 16)])
                    used = min(size, at + (1 << 16))
                    while not unpack.eof:
                        record += unpack.decompress(raw[used : used + (1 << 16)])
                        used = min(size, used + (1 << 16))
                    at = used - len(unpack.unused_data)
                    head, _, rest = record.partition(b"\r\n\r\n")
                    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                    block = rest[: int(fields["Content-Length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    kind = fields["WARC-Type"]
                    if hashlib.sha1(block).digest() != base64.b32decode(fields["WARC-Block-Digest"].removeprefix("sha1:")) or kind == "response" and hashlib.sha1(payload).digest() != digest:
                        raise ValueError(f"a digest in {name} is wrong")
                    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, length, digest.hex(), refers))
                    seen += 1
                if seen != records:
                    raise ValueError(f"{name} has not {records} records")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    spread = manifest.repartition(max(1, min(manifest.count(), 20_000)), "file")  # files of bounded size, one read each
    return spread.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages and returns what the archives hold when they are read back."""
    where = uri(folder or work_path(pages.sparkSession, "warc"))
    return read(write(pages, where, **options), where)

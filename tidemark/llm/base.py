"""Shared plumbing of the training-data operators: the shared work folder, written intermediate
tables, and vectorised word spans and hashes over Arrow string buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import shared_dir

M1 = np.uint64(0xBF58476D1CE4E5B9)
M2 = np.uint64(0x94D049BB133111EB)
POWER = 0x9E3779B97F4A7C15 | 1
#: Texts are worked on in groups of about this many bytes, so that a task's memory does not follow the batch size.
CHUNK_BYTES = 1 << 20
#: Arrow batches hold about so many bytes at most: a batch stands in the executor's direct memory and in the Python worker's.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES at most within, whatever the session has."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def holding(df: DataFrame, *broadcasts: Broadcast) -> DataFrame:
    """df, whose broadcasts go once `saved` has written it: executors would keep them through all later stages."""
    df.held = broadcasts
    return df


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, lost executors lose nothing."""
    path = work_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    for b in getattr(df, "held", ()):
        b.destroy()
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of `saved` that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column already."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = h ^ (h >> np.uint64(30))
    h = h * M1
    h = h ^ (h >> np.uint64(27))
    h = h * M2
    return h ^ (h >> np.uint64(31))


def string_parts(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) of a string column, null as empty, in
    groups of about chunk_bytes; a longer text is a group of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        for k, base in enumerate((POWER, pow(POWER, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base & (2**64 - 1)))
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.ones(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    NOT_ALNUM[_lo:_hi] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of non-separator bytes; no word crosses a row's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sep = separators[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    firsts, lasts = offsets[:-1], offsets[1:]
    before[firsts[firsts < n]] = True
    after[lasts[lasts > 0] - 1] = True
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(~sep & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words with A-Z lower-cased; equal words have equal hashes wherever they stand."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

"""Removal of repeated byte strings: a depth-limited most-significant-digit radix sort of the suffixes.

Suffixes are ordered through `threshold` bytes only, in passes of ever longer digits. Equal groups of the last pass are
exactly the repeated windows (a window is the first `threshold` bytes of a suffix). Windows of equal bytes have equal
digits in every pass, so a window whose digit nobody shares leaves the sort.

* First pass: a window's digit is its anchor, the string of two fifths of the window that hashes lowest, with its place
  in the window. Neighbouring windows mostly share one anchor, so they go as one run: about one row for every 30 bytes.
* Second pass: runs are cut into steps of up to eight windows; the digit is what all windows of a step have in common.
* Last pass: the window itself, in two halves.

In the first two passes a run whose bytes as a whole came earlier is removed as a whole, and the first one of each kind
goes on if others share its digit. Each pass is a range sort on digit, whole bytes and place, so a digit that a third of
all rows share is dealt to many tasks. Strings stand in the sort as 64-bit fingerprints, two of them for each comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .base import CHUNK_BYTES, _powers, forget, mix, saved, string_parts

BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 8
PLACES = 1 << 15
#: A run's row: the text's id and the place in it (a digest of the text, then the first window's start), the digit, the whole bytes'
#: fingerprint, and the number of windows with the anchor's distance from the first one.
RUN = "digit long, whole long, doc long, at long, shape int"
INDEX_BITS = np.uint64(22)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def _digest(text_col: str) -> Column:
    return F.pmod(F.xxhash64(text_col), F.lit(2**31))


class Pieces:
    """Fingerprints of any substring of some texts."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def prints(self, starts: np.ndarray, ends: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """Of the strings from starts to ends, with small numbers that tell strings of one print apart."""
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        for x in more:
            h = mix(h) + x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(h)


def pieces(column: pa.Array, threshold: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, first start in its text, start after the last, bytes, offsets of rows): groups of texts of about
    CHUNK_BYTES; a longer text in stretches that share threshold - 1 bytes, so that each window lies in one."""
    for lo, _, data, offsets in string_parts(column):
        if len(data) <= 2 * CHUNK_BYTES:
            yield lo, 0, len(data), data, offsets
            continue
        for start in range(0, len(data) - threshold + 1, CHUNK_BYTES):  # one text
            part = data[start : start + CHUNK_BYTES + threshold - 1]
            yield lo, start, start + CHUNK_BYTES, part, np.array([0, len(part)])


def anchored_runs(data: np.ndarray, offsets: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """Row, first start, number of windows, anchor's place, digit and whole print of each run of windows of one anchor."""
    none = (np.zeros(0, np.int64),) * 6
    width = max(1, 2 * threshold // 5)
    if len(data) < threshold:
        return none
    own = Pieces(data)
    at = np.arange(len(data) - width + 1)
    hashes = own.prints(at, at + width)
    low = (hashes & ~np.uint64((1 << int(INDEX_BITS)) - 1)) | at.astype(np.uint64)
    span, wanted = 1, threshold - width + 1
    while span < wanted:  # minima of twice as many neighbours each time; of equal ones the leftmost
        step = min(span, wanted - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    anchor = (low & np.uint64((1 << int(INDEX_BITS)) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + threshold <= offsets[row + 1]
    starts, anchor, row = starts[inside], anchor[inside], row[inside]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    s, n, a = starts[first], last - first + 1, anchor[first]
    return row[first], s, n, a, hashes[a], own.prints(s, s + n - 1 + threshold, a - s, n)


def _firsts(digit: np.ndarray, whole: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of (digit, whole, doc, at): whether a row begins a digit, begins a kind (digit and whole), is repeated
    by place from its kind's first, and the number of kinds of its digit."""
    n = len(digit)
    new_digit, new_kind = np.ones(n, bool), np.ones(n, bool)
    new_digit[1:] = digit[1:] != digit[:-1]
    new_kind[1:] = new_digit[1:] | (whole[1:] != whole[:-1])
    lead = np.maximum.accumulate(np.where(new_kind, np.arange(n), 0))
    later = (doc != doc[lead]) | (at != at[lead])
    group = np.cumsum(new_digit) - 1
    return new_digit, new_kind, later, np.bincount(group, weights=new_kind)[group].astype(np.int64)


def _batch(columns: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(columns[f.name].view(np.int64) if columns[f.name].dtype == np.uint64 else columns[f.name], f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


RUN_ARROW = pa.schema([("digit", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("shape", pa.int32()), ("removed", pa.bool_())])


def _combined(digit, whole, doc, at, shape) -> pa.RecordBatch:
    """Rows of one group of texts; what repeats an earlier row of the same group is marked as removed at once."""
    digit, whole = digit.view(np.int64), whole.view(np.int64)
    order = np.lexsort((at, doc, whole, digit))
    digit, whole, doc, at, shape = (x[order] for x in (digit, whole, doc, at, shape))
    _, new_kind, later, _ = _firsts(digit, whole, doc, at)
    keep = new_kind | later
    return _batch({"digit": digit[keep], "whole": whole[keep], "doc": doc[keep], "at": at[keep], "shape": shape[keep].astype(np.int32), "removed": later[keep]}, RUN_ARROW)


def first_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """Runs of one anchor of docs (doc, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, digest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, begin, _, data, offsets in pieces(batch.column(2), threshold):
                row, s, n, a, digit, whole = anchored_runs(data, offsets, threshold)
                if len(row):
                    at = (digest[lo + row] << 32) + s - offsets[row] + begin
                    yield _combined(digit, whole, doc[lo + row], at, (a - s) * PLACES + n)

    return docs.mapInArrow(run, RUN + ", removed boolean")


def _listed(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple]:
    """Of rows (doc, digest, text, list of runs): per group of texts the rows' documents, prints, starts, numbers of windows and anchors
    of the runs in bytes of the group, and what to add to such a start to get `at`."""
    doc, digest = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    lists = batch.column(3)
    ends = lists.offsets.to_numpy()
    values = lists.values
    start, shape = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    for lo, begin, beyond, data, offsets in pieces(batch.column(2), threshold):
        hi = lo + len(offsets) - 1
        own = np.arange(ends[lo], ends[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        s, n, a = start[own], shape[own] % PLACES, start[own] + shape[own] // PLACES
        here = (s >= begin) & (s < beyond)
        s, n, a, row = s[here], n[here], a[here], row[here]
        if len(s):
            shift = offsets[row] - begin
            yield doc[lo + row], Pieces(data), s + shift, n, a + shift, (digest[lo + row] << 32) - shift


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of n members: each member's run and its number in it."""
    run = np.repeat(np.arange(len(n)), n)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def second_rows(listed: DataFrame, threshold: int, step: int) -> DataFrame:
    """Steps of runs of docs (doc, digest, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, own, s, n, a, add in _listed(batch, threshold):
                high, low = (a - s) // step, (a - s - n + 1) // step  # places of the anchor from the first and from the last window
                r, k = _each(high - low + 1)
                q = high[r] - k
                first, last = np.maximum(s[r], a[r] - step * q - step + 1), np.minimum(s[r] + n[r] - 1, a[r] - step * q)
                core = a[r] - step * q
                digit = own.prints(core, core - step + 1 + threshold, q)
                yield _combined(digit, own.prints(first, last + threshold, core - first, last - first), doc[r], add[r] + first, last - first + 1)

    return listed.mapInArrow(run, RUN + ", removed boolean")


def last_rows(listed: DataFrame, threshold: int) -> DataFrame:
    """Windows of steps of docs (doc, digest, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, own, s, n, _, add in _listed(batch, threshold):
                r, k = _each(n)
                w, half = s[r] + k, threshold // 2
                yield _combined(own.prints(w, w + half), own.prints(w + half, w + threshold), doc[r], add[r] + w, np.ones(len(w), np.int64))

    return listed.mapInArrow(run, RUN + ", removed boolean")


def ordered(rows: DataFrame) -> DataFrame:
    keys = ("digit", "whole", "doc", "at")
    return rows.filter("not removed").drop("removed").repartitionByRange(*keys).sortWithinPartitions(*keys)


def shared_digits(rows: DataFrame) -> DataFrame:
    """rows, sorted, that are removed (an earlier row has their bytes) or go on (another row has their digit and other bytes).

    A digit that goes on beyond a batch of sorted rows counts as shared, which costs work and no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digit, whole, doc, at, shape = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            _, new_kind, later, kinds = _firsts(digit, whole, doc, at)
            cut = (digit == digit[0]) | (digit == digit[-1])
            keep = later | (new_kind & ((kinds > 1) | cut))
            yield _batch({"digit": digit[keep], "whole": whole[keep], "doc": doc[keep], "at": at[keep], "shape": shape[keep], "removed": later[keep]}, RUN_ARROW)

    return ordered(rows).mapInArrow(run, RUN + ", removed boolean")


PLACE = "part int, kind int, digit long, whole long, doc long, at long"
PLACE_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("digit", pa.int64()), ("whole", pa.int64()), ("doc", pa.int64()), ("at", pa.int64())])


def repeated_windows(rows: DataFrame) -> DataFrame:
    """doc, at of the windows whose bytes came earlier. Groups cross the ends of partitions: of each partition its first
    window and the first window of its last group are compared on the driver, two rows a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lead, head = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            digit, whole, doc, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if lead is not None:  # the last group's first window stands before the batch
                digit, whole, doc, at = (np.insert(x, 0, v) for x, v in zip((digit, whole, doc, at), lead, strict=True))
            else:
                head = [x[:1] for x in (digit, whole, doc, at)]
            _, new_kind, later, _ = _firsts(digit, whole, doc, at)
            first = np.flatnonzero(new_kind)[-1]
            lead = [x[first] for x in (digit, whole, doc, at)]
            m = int(later.sum())
            yield _batch({"part": np.full(m, part), "kind": np.zeros(m, int)} | dict(zip(("digit", "whole", "doc", "at"), (x[later] for x in (digit, whole, doc, at)), strict=True)), PLACE_ARROW)
        if lead is not None:
            for kind, values in ((1, head), (2, [np.array([v]) for v in lead])):
                yield _batch({"part": np.array([part]), "kind": np.array([kind])} | dict(zip(("digit", "whole", "doc", "at"), values, strict=True)), PLACE_ARROW)

    found = saved(ordered(rows).mapInArrow(run, PLACE), "places")
    edges: dict[int, dict[int, tuple]] = {}
    for r in found.filter("kind > 0").collect():
        edges.setdefault(r.part, {})[r.kind] = ((r.digit, r.whole), (r.doc, r.at))
    more, group, first = [], None, None
    for part in sorted(edges):
        (head, place), (tail, begins) = edges[part][1], edges[part][2]
        if head == group and place != first:
            more.append(place)
        if tail != group:
            group, first = tail, begins
    places = found.filter("kind = 0").select("doc", "at")
    return places.unionByName(found.sparkSession.createDataFrame(more, "doc long, at long")) if more else places


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (start, end in bytes) of every row.

    A byte goes if a string of `threshold` bytes that covers it also starts earlier: in a text of smaller id, or earlier in
    the same text; overlaps count, and strings are judged on the texts as given. Null and empty texts have no bytes. A null
    id comes before all others; texts of one id come in the order of their hashes, and rows that repeat id and text are one
    text, returned as often as they stand. Very long texts are worked on in stretches. An empty table gives no rows; other
    columns are ignored, whatever their names."""
    if not 0 < threshold < PLACES:
        raise ValueError(f"threshold must be from 1 to {PLACES - 1}")
    source = docs.select(F.col(id_col).alias("doc_id"), _doc(id_col).alias("doc"), _digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    texts = source.filter(F.octet_length("text") >= threshold).select("doc", "digest", "text")

    def with_text(rows: DataFrame) -> DataFrame:
        """The texts of rows that go on, each with its rows as a list (no longer than its text)."""
        start = F.col("at").bitwiseAND(F.lit(2**32 - 1))
        lists = rows.filter("not removed").groupBy("doc", F.shiftright("at", 32).alias("digest")).agg(F.collect_list(F.struct(start.alias("start"), "shape")).alias("runs"))
        return texts.join(lists, ["doc", "digest"]).select("doc", "digest", "text", "runs")

    runs = saved(first_rows(texts, threshold), "runs")
    shared = saved(shared_digits(runs), "runs_shared")
    steps = saved(second_rows(with_text(shared), threshold, min(STEP, threshold)), "steps")
    steps_shared = saved(shared_digits(steps), "steps_shared")
    windows = saved(last_rows(with_text(steps_shared), threshold), "windows")
    last = repeated_windows(windows)
    removed = [t.filter("removed").select("doc", "at", (F.col("shape") % PLACES).alias("n")) for t in (runs, shared, steps, steps_shared, windows)]
    every = removed[0]
    for t in [*removed[1:], last.withColumn("n", F.lit(1))]:
        every = every.unionByName(t)
    start = F.col("at").bitwiseAND(F.lit(2**32 - 1))
    spans = saved(every.groupBy("doc", F.shiftright("at", 32).alias("digest")).agg(F.collect_list(F.struct(start.alias("start"), (start + F.col("n") - 1 + threshold).alias("end"))).alias("spans")), "spans")
    forget(runs, shared, steps, steps_shared, windows)
    return cut_out(source.join(spans, ["doc", "digest"], "left").select("doc_id", "text", "spans"))


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def cut_out(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, spans) with the spans' union taken out of the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text, listed = batch.column(1)[k].as_py(), batch.column(2)[k]
                raw = (text or "").encode()
                spans = []
                if listed.is_valid:
                    start, end = (listed.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    new = np.append(True, start[1:] > reach[:-1])
                    first = np.flatnonzero(new)
                    spans = list(zip(start[first].tolist(), reach[np.append(first[1:], len(start)) - 1].tolist(), strict=True))
                kept, at = hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(RESULT)[1:], strict=True)]], schema=RESULT)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")

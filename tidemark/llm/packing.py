"""Packing token sequences as a cutting-stock problem.

Documents are cut every `capacity` tokens; what is left of each is one piece of 1 to capacity tokens. Only the
histogram of piece lengths (at most `capacity` rows) reaches the driver, where a linear program over cutting
patterns is solved by column generation: an unbounded-knapsack dynamic program prices new patterns with the
duals. Rounded-down pattern counts, and exact subset sums for the few pieces that rounding leaves, are then
assigned to pieces by their rank among the pieces of the same length, with a join and no further search.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import saved

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str):
    """A tiktoken encoding with the ranks of a byte-level BPE file of the tokenizers library; same ids, several times the speed."""
    if path not in _ENCODERS:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _ENCODERS[path] = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_ids(path: str, text: str, end_id: int) -> np.ndarray:
    """The ids of one text and end_id. Runs of white space that the fast library's pattern cannot take go to the slower one."""
    try:
        ids = encoder(path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        from tokenizers import Tokenizer

        ids = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    return np.append(ids.astype("<u4"), np.uint32(end_id))


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece of at most capacity tokens."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                out: list[list] = [[] for _ in schema]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = token_ids(vocabulary, text or "", end_id)
                    for at in range(0, len(ids), capacity):
                        own = ids[at : at + capacity]
                        for column, value in zip(out, (doc_id, at, len(own), zlib.crc32(own.tobytes()), len(ids), own), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


def _price(duals: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the largest sum of duals of lengths that fit c, repeats allowed; took[c]: the last one, -1 for none."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(duals > 1e-12)
    own, worth = lengths[useful], duals[useful]
    until = np.searchsorted(own, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], -2  # -2: one token stays free
        if k := until[c]:
            sums = worth[:k] + best[c - own[:k]]
            j = int(sums.argmax())
            if sums[j] > best[c]:
                best[c], took[c] = sums[j], useful[j]
    return best, took


def _pattern(took: np.ndarray, lengths: np.ndarray, c: int, first: int | None = None) -> np.ndarray:
    made = np.zeros(len(lengths))
    if first is not None:
        made[first] += 1
        c -= lengths[first]
    while c > 0 and took[c] != -1:
        if took[c] == -2:
            c -= 1
        else:
            made[took[c]] += 1
            c -= lengths[took[c]]
    return made


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, start: list[np.ndarray], gap: float = 1e-3, pricings: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Columns (patterns) of the last basis and their amounts; the revised simplex method on min sum(x), A x = demand.

    The start columns enter first. Then duals price new ones: half-way to the duals length / capacity, which are
    feasible whatever the patterns, and as they are where that finds none. Ends when no column improves, when the
    value is within `gap` of the dual bound, or after `pricings` programs."""
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1 / (capacity // lengths))
    amounts, duals = inverse @ demand.astype(float), inverse.sum(axis=0)
    even = lengths / capacity
    bound = float(even @ demand)

    def enter(column: np.ndarray) -> bool:
        nonlocal amounts, duals
        if duals @ column <= 1 + 1e-9:
            return False
        u = inverse @ column
        rising = u > 1e-9
        ratios = np.full(m, np.inf)
        ratios[rising] = amounts[rising] / u[rising]
        out = int(ratios.argmin())
        amounts = np.maximum(amounts - ratios[out] * u, 0)
        amounts[out] = ratios[out]
        row = inverse[out] / u[out]
        duals = duals - (u.sum() - 1) * row
        moved = np.flatnonzero(np.abs(u) > 1e-12)
        inverse[moved] -= np.outer(u[moved], row)
        inverse[out] = row
        basis[:, out] = column
        return True

    for column in start:
        enter(column)
    for _ in range(pricings):
        top = _price(duals, lengths, capacity)[0][capacity]
        bound = max(bound, float(duals @ demand) / max(top, 1))
        if top <= 1 + 1e-9 or amounts.sum() <= (1 + gap) * bound:
            break
        for priced in ((duals + even) / 2, duals):
            best, took = _price(priced, lengths, capacity)
            gains = priced + best[capacity - lengths]
            if sum(enter(_pattern(took, lengths, capacity, first)) for first in [None, *np.argsort(-gains)[:20]]):
                break
    return basis, amounts


def fill_exactly(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often: each takes the longest piece and the subset that fills the rest best, as often as
    there are pieces for it."""
    left, made = {k: n for k, n in left.items() if n}, []
    while left:
        longest = max(left)
        own, room, bits, trail = {longest: 1}, capacity - longest, 1, []
        left[longest] -= 1
        full = (1 << (room + 1)) - 1
        for length in sorted((k for k, n in left.items() if n and k <= room), reverse=True):
            n, part = min(left[length], room // length), 1
            while n > 0:
                take = min(part, n)
                trail.append((length, take, bits))
                bits |= (bits << (length * take)) & full
                n, part = n - take, part * 2
            if bits >> room & 1:
                break
        c = bits.bit_length() - 1
        left[longest] += 1
        for length, take, before in reversed(trail):
            if not before >> c & 1:
                own[length] = own.get(length, 0) + take
                c -= length * take
        times = min(left[k] // n for k, n in own.items())
        for k, n in own.items():
            left[k] -= n * times
        left = {k: n for k, n in left.items() if n}
        made.append((own, times))
    return made


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces a sequence, first sequence, offset) that assign every piece."""
    patterns: list[tuple[dict[int, int], int]] = []
    left = dict(histogram)
    if n := left.pop(capacity, 0):
        patterns.append(({capacity: 1}, n))
    if left:
        lengths = np.array(sorted(left))
        start = []
        for own, _ in fill_exactly(left, capacity):
            start.append(np.zeros(len(lengths)))
            start[-1][np.searchsorted(lengths, list(own))] = list(own.values())
        columns, amounts = column_generation(lengths, np.array([left[k] for k in lengths]), capacity, start)
        for j in np.argsort(-amounts, kind="stable"):
            own = {int(lengths[i]): int(columns[i, j]) for i in np.flatnonzero(columns[:, j])}
            if times := min([int(amounts[j] + 1e-7), *(left[k] // n for k, n in own.items())]):
                patterns.append((own, times))
                for k, n in own.items():
                    left[k] -= n * times
        patterns += fill_exactly(left, capacity)
    rank = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for own, times in patterns:
        offset = 0
        for k in sorted(own, reverse=True):
            rows.append((k, rank[k], own[k] * times, own[k], sequence, offset))
            rank[k] += own[k] * times
            offset += own[k] * k
        sequence += times
    return rows


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, with_ids: bool = False, group_rows: int = 100_000, broadcast_groups: int = 2_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) of each piece.

    A document's ids are those of the vocabulary file, then end_id; a null or empty text is end_id alone. Every id
    lies in exactly one piece; pieces of a sequence follow each other without gaps from offset 0. Repeated rows are
    packed as often as they stand, ties get any order among equal pieces; an empty table gives no rows; very long texts
    give many pieces. Other columns are ignored, whatever their names.

    Pieces are ranked among those of their length; a length with many pieces (most are of `capacity`) is dealt into groups
    of about `group_rows`, so no task sorts all of them."""
    cut = saved(pieces(docs, vocabulary, id_col, text_col, capacity, end_id, with_ids), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    hot = {length: -(-n // group_rows) for length, n in histogram.items() if n > group_rows}
    groups = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("length")), F.lit(1)) if hot else F.lit(1)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), groups))
    spark = docs.sparkSession
    rows = plan(histogram, capacity) or [(0, 0, 0, 1, 0, 0)]
    assign = spark.createDataFrame(rows, "length long, first_rank long, n long, each long, first_sequence long, first_offset long")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = cut.withColumn("rank", rank)
    if hot:
        counts = cut.filter(F.col("length").isin(list(hot))).groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = saved(counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before")), "groups")
        before = F.broadcast(before) if sum(hot.values()) <= broadcast_groups else before  # about 50 MB
        ranked = ranked.join(before, ["length", "salt"], "left").withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    a = F.broadcast(assign.withColumnRenamed("length", "of"))  # as many rows as the plan has, bounded by capacity
    placed = ranked.join(a, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n")))
    at = F.col("rank") - F.col("first_rank")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("first_offset") + at % F.col("each") * F.col("length")).alias("offset"), *["ids"] * with_ids)

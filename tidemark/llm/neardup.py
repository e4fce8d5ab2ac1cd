"""MinHash near-duplicate groups by tensored banding.

Two small collections of minhash tuples are computed for each distinct shingle set, and every pair of a
tuple of the first and a tuple of the second is a table key: `left_bands * right_bands` tables from
`left_bands * left_rows + right_bands * right_rows` minhashes. Documents that share a key are candidates;
all links are confirmed on the full shingle sets.

No bucket is expanded into all of its pairs. Per round, every bucket compares its members with one hub
(another one each round), and only members whose component is not the hub's are compared. Shingles that
only one candidate has can be in no intersection, so their number bounds what a document can share: one with
too many of them has no link at all, and the bound decides most of what is left in more than one component
after the rounds. The rest is compared across components, so all candidates are decided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import forget, mix, saved, string_parts, word_hashes, word_spans


@dataclass(frozen=True)
class Banding:
    """Sizes of the two collections. `for_threshold` takes as many tuples as a pair at the threshold needs to
    be found with probability `recall`."""

    left_rows: int
    left_bands: int
    right_rows: int
    right_bands: int

    @staticmethod
    def for_threshold(threshold: float, recall: float = 0.9999, left_rows: int = 2, right_rows: int = 3) -> Banding:
        miss = 1 - math.sqrt(recall)
        bands = lambda rows: max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))
        return Banding(left_rows, bands(left_rows), right_rows, bands(right_rows))

    @property
    def hashes(self) -> int:
        return self.left_rows * self.left_bands + self.right_rows * self.right_bands


def _constants(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, their sets' sizes, and the distinct shingle hashes, ascending in each row."""
    starts, ends, row = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = word_hashes(data, starts, ends)
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    turn = _constants(width)
    n = len(words)
    if n >= width:
        whole = sum((words[k : n - width + 1 + k] * turn[k] for k in range(1, width)), words[: n - width + 1] * turn[0])
        keep = row[: n - width + 1] == row[width - 1 :]
        hashes, owner = mix(whole[keep]), row[: n - width + 1][keep]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero(count < width)
    if len(short):
        whole = np.full(len(short), np.uint64(0xA5A5A5A5))
        for k in range(width - 1):
            has = count[short] > k
            whole[has] += words[first[short[has]] + k] * turn[k] + np.uint64(k + 1)
        hashes, owner = np.concatenate([hashes, mix(whole)]), np.concatenate([owner, rows[short]])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    rows, size = np.unique(owner, return_counts=True)
    return rows, size, hashes


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, hashes: int) -> DataFrame:
    """id, size of the shingle set, two sums that identify the set, and its minhashes (null for an empty set)."""
    factors = _constants(hashes)
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("mins", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in string_parts(texts):
                rows, size, h = shingle_sets(data, offsets, width)
                n = hi - lo
                sizes, s1, s2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                mins = np.zeros((len(rows), hashes), np.int32)
                if len(rows):
                    at = np.concatenate([[0], np.cumsum(size)[:-1]])
                    sizes[rows] = size
                    s1[rows] = np.add.reduceat(mix(h + np.uint64(1)), at)
                    s2[rows] = np.add.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), at)
                    for k in range(hashes):
                        mins[:, k] = np.minimum.reduceat(((h ^ factors[k]) * factors[k]) >> np.uint64(33), at).astype(np.int32)
                full = np.zeros(n, bool)
                full[rows] = True
                bounds = np.concatenate([[0], np.cumsum(full) * hashes]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(mins.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n).cast(pa.int64()), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, size long, s1 long, s2 long, mins array<int>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id and its whole set of shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in string_parts(batch.column(1)):
                rows, size, h = shingle_sets(data, offsets, width)
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(rows)).cast(pa.int64()), lists], names=["id", "shingles"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, shingles array<long>")


def table_keys(classes: DataFrame, banding: Banding) -> DataFrame:
    """id, size and one row for each pair of tuples."""
    b, at = banding, banding.left_rows * banding.left_bands
    tuples = lambda start, rows, bands: F.array(*[F.xxhash64(F.lit(start + i), *[F.col("mins")[start + i * rows + r] for r in range(rows)]) for i in range(bands)])
    left, right = tuples(0, b.left_rows, b.left_bands), tuples(at, b.right_rows, b.right_bands)
    return classes.select("id", "size", F.explode(left).alias("l"), right.alias("rs")).select("id", "size", "l", F.explode("rs").alias("r")).select(F.xxhash64("l", "r").alias("key"), "id", "size")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); root is the smallest node reachable.

    Each round sends every root to the least of its neighbours and halves the paths, then contracts the edges; all
    steps are joins and grouped minima, and each round's tables are written, so no lineage grows."""
    edges = saved(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = None
    for _ in range(rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")), "step")
        up = step.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        step = saved(step.join(up, "up", "left").select("node", F.coalesce("up2", "up").alias("root")), "roots")
        if nodes is None:
            nodes = step
        else:
            to = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            nodes = saved(nodes.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "nodes")
        a, b = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(a, "a").join(b, "b").filter("ra <> rb")
        edges = saved(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    else:
        if not edges.isEmpty():
            raise RuntimeError("components did not settle")
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _can_reach(size: str, own: str, size_b: str, own_b: str, percent: int) -> Column:
    """Sets of these sizes, of whose shingles `own` are in no other set, can reach the similarity."""
    most = F.least(F.col(size) - F.col(own), F.col(size_b) - F.col(own_b))
    return most * 100 >= (F.col(size) + F.col(size_b) - most) * percent


def across(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows (hub, id, root, size, own) of one hub and two roots that can reach the similarity.

    Every set is taken as its symmetric difference to the hub's: two sets differ by as much as their differences do. If two
    differences have nothing in common and the sets are similar, both are similar to the hub and so of one root already.
    Other similar pairs share a difference element among the first few of each in the order of frequency, which is what
    they are joined on; the elements' places bound the overlap. So members that vary a common text in their own
    ways are not compared with each other.
    """
    one, two = sets.select("id", "shingles"), sets.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub"))
    diff = F.concat(F.array_except("of_hub", "shingles"), F.array_except("shingles", "of_hub"))
    rows = left.distinct().join(one, "id").join(two, "hub").select("hub", "id", "root", "size", "own", diff.alias("diff"))
    parts = saved(rows.withColumn("d", F.size("diff")).select("hub", "id", "root", "size", "own", "d", F.explode("diff").alias("e")), "differences")
    common = parts.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 1 and lo <> hi").select("hub", "e", "n")
    kept = parts.join(common, ["hub", "e"])
    own = Window.partitionBy("hub", "id")
    # elements of no other root come first, whatever their number
    kept = kept.withColumn("place", F.row_number().over(own.orderBy("n", "e")) + F.col("d") - F.count(F.lit(1)).over(own))
    room = F.col("size") * ((100 - percent) / percent) + 1
    kept = saved(kept.filter(F.col("place") <= room + 1e-9).drop("n"), "prefixes")
    other = kept.select("hub", "e", F.col("id").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("own").alias("own_b"), F.col("d").alias("d_b"), F.col("place").alias("place_b"))
    differ = (F.col("size") + F.col("size_b")) * ((100 - percent) / (100 + percent))
    overlap = 1 + F.least(F.col("d") - F.col("place"), F.col("d_b") - F.col("place_b"))
    enough = 2 * overlap >= F.col("d") + F.col("d_b") - differ - 1e-6
    met = kept.join(other, ["hub", "e"]).filter((F.col("id") < F.col("b")) & (F.col("root") != F.col("root_b")) & _can_reach("size", "own", "size_b", "own_b", percent) & enough)
    return met.select(F.col("id").alias("a"), "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    inter = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(two, "b").join(one, "a").filter(inter * 100 >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def text_digest(text_col: str) -> Column:
    """Tells the texts of one id apart; null and empty are two."""
    return F.unhex(F.sha2(F.when(F.col(text_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(text_col).cast("string"))).cast("binary"), 256))


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """The non-null ids that several rows have."""
    ids = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null")
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, rounds: int = 3, recall: float = 0.9999, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row (with `by_text` also stays, and the digest of the text
    where some ids repeat).

    Words are runs of non-space bytes, A-Z lower-cased; the set is the distinct `width`-word shingles, or the whole
    sequence where there are fewer words. Rows whose intersection is `percent` or more of the union are linked;
    component_id is the smallest id reachable, kept marks the rows of that id. Null, empty and blank texts have size 0 and
    are linked with nothing. Equal texts (and equal sets) always share a component. Repeated rows come back as often as
    they stand. Texts of one id are each linked by their own words, as those of different ids are; of each component one
    text `stays`, that of the smallest digest among those of the smallest id. A row of null id has the component of its set if other
    rows have that set, else a null one; it is kept and stays. Very long texts are worked on whole; an empty table gives no rows. Other columns are ignored, whatever their
    names.
    """
    digest = text_digest(text_col)
    names = ["doc_id", "n_shingles", "component_id", "kept"]
    repeated = saved(repeated_ids(docs, id_col), "repeated")
    if repeated.isEmpty():
        linked = linked_texts(docs, id_col, text_col, percent, width, rounds, recall)
        return linked.select(*names, *[F.lit(None).cast("binary").alias("digest"), F.col("kept").alias("stays")] * by_text)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"), digest.alias("digest"))
    rows = rows.join(repeated.withColumn("again", F.lit(True)), "id", "left")
    for seed in range(99):  # texts of repeated ids get numbers of their own that nothing else has
        node = F.when(F.col("again"), F.xxhash64(F.lit(seed), "id", "digest")).otherwise(F.col("id"))
        nodes = saved(rows.select(node.alias("node"), "id", "digest").distinct(), "nodes")
        if nodes.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
        forget(nodes)
    linked = linked_texts(rows.select(node.alias("node"), "_text"), "node", "_text", percent, width, rounds, recall)
    linked = saved(linked.select(F.col("doc_id").alias("node"), "n_shingles", F.col("component_id").alias("root")), "linked")
    some = linked.filter("node is not null").join(nodes, "node")
    least = some.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("least"))
    joined = some.join(least, "root").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least.id").alias("component_id"), (F.col("id") == F.col("least.id")).alias("kept"), "digest", (F.struct("id", "digest") == F.col("least")).alias("stays"))
    none = F.lit(None).cast("long")
    bare = linked.filter("node is null").join(least, "root", "left").select(none.alias("doc_id"), "n_shingles", F.col("least.id").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("binary").alias("digest"), F.lit(True).alias("stays"))
    return joined.unionByName(bare).select(*names, *["digest", "stays"] * by_text)


def linked_texts(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int, rounds: int, recall: float) -> DataFrame:
    """`near_duplicates` where each id has one text."""
    banding = Banding.for_threshold(percent / 100, recall)
    sig = saved(signatures(docs, id_col, text_col, width, banding.hashes), "signatures")
    least = saved(sig.filter("size > 0 and id is not null").groupBy("size", "s1", "s2").agg(F.min("id").alias("first")), "classes")
    classes = sig.join(least.select(F.col("first").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keys = saved(table_keys(classes, banding).repartition("key"), "keys")
    shared = saved(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared")
    members = saved(keys.join(shared, "key", "left_semi"), "members")
    forget(keys, shared)
    raw = members
    touched = members.select("id").distinct()
    picked = docs.withColumn("__id", F.col(id_col).cast("long"))
    sets = saved(full_sets(picked.join(touched.withColumnRenamed("id", "__id"), "__id", "left_semi"), id_col, text_col, width).dropDuplicates(["id"]), "sets")
    alone = sets.select("id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1")
    members = members.join(alone.groupBy("id").agg(F.count(F.lit(1)).alias("own")), "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    members = saved(members.filter((F.col("size") - F.col("own")) * 100 >= F.col("size") * percent), "linkable")
    forget(raw)
    roots = links = None
    for r in range(rounds + 1):  # the last one stays with the hubs of the one before, which all members have met
        now = members.withColumn("root", F.col("id"))
        if roots is not None:
            now = members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        hub = F.struct(F.xxhash64(F.lit(min(r, rounds - 1)), "id").alias("o"), F.col("id").alias("hub"), F.col("root").alias("hub_root"), F.col("size").alias("hub_size"), F.col("own").alias("hub_own"))
        hubs = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(hub).alias("h"))
        mixed = saved(hubs.filter("lo <> hi").select("key", "h.hub", "h.hub_root", "h.hub_size", "h.hub_own"), "mixed")
        if r < rounds:
            met = now.join(mixed, "key").filter((F.col("root") != F.col("hub_root")) & _can_reach("size", "own", "hub_size", "hub_own", percent))
            pairs = met.select(F.col("hub").alias("a"), F.col("id").alias("b"))
        else:
            pairs = across(now.join(mixed.select("key", "hub"), "key").select("hub", "id", "root", "size", "own"), sets, percent)
        found = saved(confirmed(pairs.distinct(), sets, percent), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.unionByName(found)
        roots = saved(components(links), "components")
    forget(members, sets)
    labels = least
    if roots is not None:
        labels = least.join(roots.withColumnRenamed("node", "first"), "first", "left").withColumn("first", F.coalesce("root", "first")).drop("root")
    out = sig.select("id", "size", "s1", "s2").join(labels, ["size", "s1", "s2"], "left")
    component = F.coalesce("first", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

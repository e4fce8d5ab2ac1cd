"""Merkle manifest of a table: a proof for each row, by a butterfly exchange between partitions.

Rows are ranked within their group (language) by a range sort; eight to the fourth consecutive ones are a block, whose
subtree one task hashes. Then aligned neighbourhoods of eight subtrees exchange roots round by round: each block meets one
block of each of the other seven subtrees, learns their roots, and hashes the common ancestor itself, as all blocks below
that ancestor do. After the last round each block knows what stands beside its path up to the root; nothing is handed
down. Where subtrees have unlike numbers of blocks (the last one of a group, groups beside each other), the blocks of
the smaller ones meet several neighbours in turn, so no block meets more than its share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import forget, saved

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _value(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the columns' values, each as `-` if null, else its length in bytes, a colon and its text."""
    return F.unhex(F.sha2(F.concat(*[_value(c) for c in columns]).cast("binary"), 256))


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(nodes: list[str], least: int = 0) -> list[list[str]]:
    """nodes and the levels above them, up to one node and at least `least` levels up."""
    found = [nodes]
    while len(found[-1]) > 1 or len(found) <= least:
        found.append([_digest(found[-1][k : k + FANOUT]) for k in range(0, len(found[-1]), FANOUT)])
    return found


def _leaves(members: pa.Array, name: str) -> list[str]:
    return [x.hex() for x in members.field(name).to_pylist()]


def block_roots(blocks: DataFrame, block_levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, width = batch.column("members"), batch.column("width").to_pylist()
            roots = [levels(_leaves(members[k].values, "leaf"), block_levels * (width[k] > 1))[-1][0] for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("nth"), batch.column("block"), batch.column("width"), pa.array(roots, pa.string())], names=["nth", "block", "width", "node"])

    return blocks.mapInArrow(run, "nth int, block long, width long, node string")


def exchange(state: DataFrame, group: list[Column], digit: Column, rank: Column, size: Column, most: Column) -> DataFrame:
    """One round: the blocks of up to eight subtrees learn the roots (`node`) of one another.

    group and digit tell the neighbourhood and the subtree in it, rank and size the block's number among those of its subtree
    and how many those are, most the largest size in the neighbourhood. A block of rank k meets the blocks of rank k, k + size,
    k + 2 size, ... of larger subtrees."""
    names = [f"group{k}" for k in range(len(group))]
    sent = state.select("*", *[c.alias(n) for c, n in zip(group, names, strict=True)], digit.alias("digit"), rank.alias("rank"), F.explode(F.sequence(rank, most - 1, size)).alias("slot"))
    own = F.when(F.col("slot") == F.col("rank"), F.struct("digit", *state.columns))
    met = sent.groupBy(*names, "slot").agg(F.sort_array(F.collect_list(F.struct("digit", "node"))).alias("nodes"), F.collect_list(own).alias("blocks"))
    met = met.select("nodes", F.explode("blocks").alias("b"))

    def joined(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda x: x["node"]), "")

    beside = F.struct(joined(F.filter("nodes", lambda x: x["digit"] < F.col("b.digit"))).alias("left"), joined(F.filter("nodes", lambda x: x["digit"] > F.col("b.digit"))).alias("right"))
    now = {"node": F.sha2(joined(F.col("nodes")).cast("binary"), 256), "path": F.concat(F.col("b.path"), F.array(beside))}
    return met.select(*[now.get(c, F.col(f"b.{c}")).alias(c) for c in state.columns])


def _within(state: DataFrame, level: int) -> DataFrame:
    """Round `level` of the blocks of each group; groups that have one node by now stay as they are."""
    below = 1 << FANOUT_BITS * level
    subtree = F.shiftright("block", FANOUT_BITS * level)
    first = F.shiftright("block", FANOUT_BITS * (level + 1)) * (below * FANOUT)
    size = F.least(F.lit(below), F.col("width") - subtree * below)
    most = F.least(F.lit(below), F.col("width") - first)
    met = exchange(state.filter(F.col("width") > below), [F.col("nth"), first], subtree % FANOUT, F.col("block") % below, size, most)
    return met.unionByName(state.filter(F.col("width") <= below))


def _between(state: DataFrame, groups: DataFrame, level: int) -> DataFrame:
    """Round `level` over the groups' own roots."""
    subtree, above = F.shiftright("nth", FANOUT_BITS * level), F.shiftright("nth", FANOUT_BITS * (level + 1))
    own = Window.partitionBy(subtree)
    sizes = groups.select("nth", (F.col("before") - F.min("before").over(own)).alias("skip"), F.sum("width").over(own).alias("size"))
    sizes = sizes.select("nth", "skip", "size", F.max("size").over(Window.partitionBy(above)).alias("most"))
    columns = state.columns
    state = state.join(sizes, "nth").withColumn("rank_", F.col("skip") + F.col("block"))
    return exchange(state, [above], subtree % FANOUT, F.col("rank_"), F.col("size"), F.col("most")).select(columns)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = hashlib.sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def row_proofs(blocks: DataFrame, block_levels: int) -> DataFrame:
    """The rows of blocks (members, width, path, subroot, root) with their proofs folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members, width, subroot, root = (batch.column(c)[k] for c in ("members", "width", "subroot", "root"))
                above = [(x["left"], x["right"]) for x in batch.column("path")[k].as_py()]
                leaves, claimed = (_leaves(members.values, c) for c in ("leaf", "claimed"))
                tree = levels(leaves, block_levels * (width.as_py() > 1))
                top = "".join(left + right for left, right in above).encode()
                proofs, folded = [], []
                for i in range(len(leaves)):
                    path = []
                    for level in tree[:-1]:
                        lo = i // FANOUT * FANOUT
                        path.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + FANOUT])))
                        i //= FANOUT
                    proof = hashlib.sha256("".join(left + right for left, right in path).encode())
                    proof.update(top)
                    proofs.append(proof.hexdigest())
                    folded.append(path)
                folded = [_fold(c, path + above) for c, path in zip(claimed, folded, strict=True)]
                n, root = len(leaves), root.as_py()
                yield pa.RecordBatch.from_arrays(
                    [members.values.field("id"), *[pa.array(x, pa.string()) for x in (leaves, [subroot.as_py()] * n, [root] * n, proofs, folded)], pa.array([f == root for f in folded], pa.bool_())], names=RESULT_NAMES
                )

    return blocks.mapInArrow(run, RESULT)


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, block_levels: int = 4) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    leaf is the digest of the row's fields (a null is `-`); subroot that of its group's tree, root that of all groups, ordered
    bytewise with null first; each node is the digest of eight consecutive ones. proof_sha256 is the digest of what stands
    beside the path from leaf to root. folded_root is what path and a leaf of the columns in `found` (as the row is now;
    by default as it is) give, verified whether that is the root.

    Rows of a group are ordered by id, null first, then by leaf; equal rows are leaves of their own, in any order. Null texts and
    very long ones are values as others. An empty table gives no rows. Other columns are ignored, whatever their names.
    The groups' sizes stand in one table of a row a group, which one task ranks."""
    found = found or {}
    rows = docs.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), leaf([F.col(c) for c in fields]).alias("leaf"), leaf([found.get(c, F.col(c)) for c in fields]).alias("claimed"), F.monotonically_increasing_id().alias("tie")
    )
    leaves = saved(rows, "leaves")
    keys = ("grp", "id", "leaf", "tie")
    ranked = saved(leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).select("grp", "id", "leaf", "claimed", F.monotonically_increasing_id().alias("at")), "ranked")
    forget(leaves)
    part = F.shiftright("at", 33)  # the number of the partition; below it stands that of the row
    parts = ranked.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = saved(parts.withColumn("before", F.sum("n").over(Window.partitionBy("grp").orderBy("part")) - F.col("n")), "parts")
    sizes = parts.groupBy("grp").agg(F.ceil(F.sum("n") / FANOUT**block_levels).cast("long").alias("width"))
    everything = Window.orderBy(F.asc_nulls_first("grp"))
    groups = saved(sizes.select("grp", "width", (F.row_number().over(everything) - 1).alias("nth"), (F.sum("width").over(everything) - F.col("width")).alias("before")), "groups")
    starts = parts.alias("p").join(groups.alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp"))).select("nth", "width", F.col("p.grp").alias("of"), "part", (F.col("p.before") - F.col("first")).alias("shift"))
    placed = ranked.join(starts, F.col("grp").eqNullSafe(F.col("of")) & (part == F.col("part"))).withColumn("pos", F.col("at") + F.col("shift"))
    blocks = placed.groupBy("nth", "width", F.shiftright("pos", FANOUT_BITS * block_levels).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "claimed"))).alias("members"))
    blocks = saved(blocks, "blocks")
    forget(ranked, parts)
    state = saved(block_roots(blocks, block_levels), "roots").withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    widest, count = groups.agg(F.max("width"), F.count(F.lit(1))).first()
    level = 0
    while 1 << FANOUT_BITS * level < (widest or 0):
        state, level = _within(state, level), level + 1
    state, level = state.withColumn("subroot", F.col("node")), 0
    while 1 << FANOUT_BITS * level < count:
        state, level = _between(state, groups, level), level + 1
    state = saved(state.select("nth", "block", "path", "subroot", F.col("node").alias("root")), "paths")
    out = saved(row_proofs(blocks.join(state, ["nth", "block"]), block_levels), "proofs")
    forget(blocks, state, groups)
    return out

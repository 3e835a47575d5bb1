"""A Merkle manifest of a dataset, its trees stored block by block in van Emde Boas order.

A leaf is the digest of a row's encoded columns. Each group of rows is a tree of `ARITY` children a node
over its leaves in order; the groups' roots are the leaves of a last tree, whose root stands for all.

A tree is cut into aligned blocks of up to `ARITY ** HEIGHT` leaves. A block is one row that holds all its
nodes in the van Emde Boas order: a subtree of h levels is split at half its height, its top is stored
first, then its bottom subtrees from left to right, each in the same order. `addresses` is that order's
arithmetic; building a block and reading siblings for proofs both go by it, so neither needs pointers nor a
page size. The roots of a level's blocks are the leaves of the next level's blocks, until one is left.

Leaves are numbered in range partitions. Every block is a group of at most `ARITY ** HEIGHT` small rows, so
a group of documents with a third of all rows is many blocks. Proofs go down from the last root: a block's
path is joined to the blocks below it, and only at the end to leaves. Nothing is collected or broadcast but
counts by partition.

Cases: leaves with equal or null keys are ordered too (null first, equal keys by digest; equal digests are
interchangeable). A null group is a group of its own and comes first. A lone leaf is its tree's root, and its
proof is empty if its tree is the only one. An empty table gives an empty result. Texts are hashed in the
JVM, whatever their length. Extra columns of any name are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.materialize import Scratch, saved
from linkloom.operators.sampling import placed

#: Children of a node, and levels of nodes above the leaves of a block.
ARITY, HEIGHT = 8, 4

Steps = list[tuple[str, str]]  # hex digests left and right of a node among its siblings, from below


def leaf_digest(*columns: Column) -> Column:
    """Hex SHA-256 of all columns: each `-` if null, else its UTF-8 length, a colon and its text."""
    encoded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.sha2(F.concat(*encoded), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def size(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


@functools.lru_cache(None)
def addresses(levels: int, depth: int) -> np.ndarray:
    """Where the nodes of that depth stand, from left to right, in a subtree of so many levels."""
    if levels == 1:
        return np.zeros(1, np.int64)
    top = levels // 2
    if depth < top:
        return addresses(top, depth)
    below = addresses(levels - top, depth - top)
    starts = size(top) + np.arange(ARITY**top) * size(levels - top)
    return (starts[:, None] + below[None, :]).ravel()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    h = 0
    while ARITY**h < n:
        h += 1
    return h


def counts(n: int, h: int) -> list[int]:
    """Nodes at each depth of a block of n leaves at depth h."""
    return [-(-n // ARITY ** (h - d)) for d in range(h + 1)]


def runs(digests: list[str]) -> list[list[str]]:
    return [digests[k : k + ARITY] for k in range(0, len(digests), ARITY)]


class Block:
    """The nodes of one block in van Emde Boas order, 32 bytes each; absent ones are zero."""

    def __init__(self, nodes: bytes, n: int, h: int):
        self.nodes, self.n, self.h = np.frombuffer(nodes, np.uint8).reshape(-1, 32), n, h

    @classmethod
    def of(cls, leaves: list[str], h: int) -> Block:
        nodes = np.zeros((size(h + 1), 32), np.uint8)
        row = leaves
        for d in range(h, -1, -1):
            nodes[addresses(h + 1, d)[: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
            row = [digest("".join(run)) for run in runs(row)] if d else row
        return cls(nodes.tobytes(), len(leaves), h)

    def row(self, depth: int) -> list[str]:
        """The digests of one depth, from left to right."""
        at = addresses(self.h + 1, depth)[: counts(self.n, self.h)[depth]]
        raw = self.nodes[at].tobytes().hex()
        return [raw[k : k + 64] for k in range(0, len(raw), 64)]

    def climbs(self) -> list[Steps]:
        """For each leaf, what stands left and right of it and of its ancestors below the block's root."""
        beside = []
        for d in range(self.h, 0, -1):
            beside.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs(self.row(d)) for k in range(len(run))])
        return [[steps[i // ARITY**k] for k, steps in enumerate(beside)] for i in range(self.n)]


STEPS = "array<struct<left:string,right:string>>"
_steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def pairs(steps: list[dict]) -> Steps:
    return [(s["left"], s["right"]) for s in steps]


def steps_array(paths: list[Steps]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _steps)


def built(leaves: pa.Table, most: int) -> pa.Table:
    """One block's row from its leaves (tree, block, place, total, digest), of which there are up to
    ARITY ** most."""
    leaves = leaves.sort_by("place")
    tree, block, total = (leaves.column(c)[0].as_py() for c in ("tree", "block", "total"))
    made = Block.of(leaves.column("digest").to_pylist(), min(most, height(total)))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
    row = [tree, block, -(-total // ARITY**most), made.n, made.h, made.row(0)[0], made.nodes.tobytes()]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], names=["tree", "block", "blocks", "n", "height", "digest", "nodes"])


def forest(leaves: DataFrame, most: int, scratch: Scratch) -> list[DataFrame]:
    """The blocks of all trees, level by level from below: tree, block, blocks (of the tree at this level), n,
    height, digest (of the block's root) and nodes. leaves: tree, place (from 0), total (leaves of the
    tree) and digest."""
    out: list[DataFrame] = []
    while True:
        rows = leaves.select("tree", F.floor(F.col("place") / ARITY**most).alias("block"), "place", "total", "digest")
        level = scratch.keep(rows.groupBy("tree", "block").applyInArrow(lambda x: built(x, most), "tree string, block long, blocks long, n int, height int, digest string, nodes binary"))
        out.append(level)
        above = level.where("blocks > 1")
        if above.isEmpty():
            return out
        leaves = above.select("tree", F.col("block").alias("place"), F.col("blocks").alias("total"), "digest")


def roots(levels: list[DataFrame]) -> DataFrame:
    """tree, digest of every tree's root."""
    found = [level.where("blocks = 1").select("tree", "digest") for level in levels]
    return functools.reduce(DataFrame.unionByName, found)


def block_paths(levels: list[DataFrame], above: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    """tree, block, top, steps from the root of each lowest block to the last root. above: tree, top (passed
    on) and steps from the tree's root."""

    def down(batches):
        for batch in batches:
            trees, at, tops, paths = [], [], [], []
            for r in batch.to_pylist():
                climbs = Block(r["nodes"], r["n"], r["height"]).climbs()
                trees += [r["tree"]] * len(climbs)
                at += [r["block"] * ARITY**most + i for i in range(len(climbs))]
                tops += [r["top"]] * len(climbs)
                paths += [c + pairs(r["steps"]) for c in climbs]
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.string()), pa.array(at, pa.int64()), pa.array(tops, pa.string()), steps_array(paths)], names=["tree", "block", "top", "steps"])

    paths = None
    for k in range(len(levels) - 1, -1, -1):
        tops = levels[k].where("blocks = 1").select("tree", "block").join(above, "tree").select("tree", "block", "top", "steps")
        paths = tops if paths is None else tops.unionByName(paths)
        if k:
            full = levels[k].join(paths, ["tree", "block"]).select("tree", "block", "n", "height", "nodes", "top", "steps")
            paths = scratch.keep(full.mapInArrow(down, f"tree string, block long, top string, steps {STEPS}"))
    return paths


def leaf_paths(leaves: DataFrame, blocks: DataFrame, columns: str, most: int) -> DataFrame:
    """The named columns of leaves (a schema's text), with tree, top and steps to the last root. blocks: the
    lowest blocks with their paths."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        own = block.to_pylist()[0]
        climbs = Block(own["nodes"], own["n"], own["height"]).climbs()
        above, first = pairs(own["steps"]), own["block"] * ARITY**most
        paths = steps_array([climbs[p - first] + above for p in rows.column("place").to_pylist()])
        return pa.table({c: rows.column(c) for c in names} | {"tree": rows.column("tree"), "top": pa.array([own["top"]] * len(paths), pa.string()), "steps": paths})

    rows = leaves.select("tree", F.floor(F.col("place") / ARITY**most).alias("block"), "place", *names)
    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, f"{columns}, tree string, top string, steps {STEPS}")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place (within its tree, in the given order) and total (rows of the tree)."""
    rows = placed(rows, "tree", *order)
    sizes = rows.groupBy("tree").agg(F.min("place").alias("start"), F.count("*").alias("total"))
    return rows.join(sizes, "tree").withColumn("place", F.col("place") - F.col("start")).drop("start")


def manifest(docs: DataFrame, leaf: Column, claim: Column, key: str = "doc_id", group: str = "lang", most: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot (of the row's group), root, proof (the hex digests of all siblings, from below and
    from left to right), folded_root (what the claimed leaf gives with them) and verified, of every row. Blocks have
    up to ARITY ** most leaves."""
    scratch = Scratch(docs.sparkSession)
    # Names of groups that sort as the groups do, null first.
    tree = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group)))
    rows = docs.select(tree.alias("tree"), F.col(key).cast("long").alias("id"), leaf.alias("digest"), claim.alias("claim"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows)
    if rows.isEmpty():
        scratch.clear()
        return docs.sparkSession.createDataFrame([], f"`{key}` long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    # The row number parts equal rows, so that range partitions can.
    leaves = saved(numbered(rows, "id", "digest", "row").drop("row"))
    levels = forest(leaves, most, scratch)
    groups = scratch.keep(placed(roots(levels), "tree"))
    last = forest(groups.select(F.lit("").alias("tree"), "place", F.lit(groups.count()).cast("long").alias("total"), "digest"), most, scratch)
    root = roots(last).first().digest
    start = docs.sparkSession.createDataFrame([("", root, [])], f"tree string, top string, steps {STEPS}")
    named = groups.select(F.lit("").alias("tree"), "place", F.col("tree").alias("name"), F.col("digest").alias("subroot"))
    above = leaf_paths(named, with_paths(last, start, most, scratch), "name string, subroot string", most)
    above = scratch.keep(above.select(F.col("name").alias("tree"), F.col("subroot").alias("top"), "steps"))
    blocks = saved(with_paths(levels, above, most, scratch))
    scratch.clear()
    out = leaf_paths(leaves.withColumnRenamed("digest", "leaf"), blocks, "id long, leaf string, claim string", most)
    fold = F.aggregate("steps", F.col("claim"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select(F.col("id").alias(key), "leaf", F.col("top").alias("subroot"), F.lit(root).alias("root"), proof.alias("proof"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def with_paths(levels: list[DataFrame], above: DataFrame, most: int, scratch: Scratch) -> DataFrame:
    return levels[0].join(block_paths(levels, above, most, scratch), ["tree", "block"]).select("tree", "block", "n", "height", "nodes", "top", "steps")

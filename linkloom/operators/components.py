"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.materialize import Scratch, few, saved


def stars(links: DataFrame, n: int) -> bool:
    """Whether every u has one link (u > v) and no link leads to it: no further contraction changes such links."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    marked = few(ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")), n)
    return marked.where("out > 1 OR out > least").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", keep: Scratch | None = None) -> DataFrame:
    """node, component (the smallest node of its component) for every node of an edge.

    Alternates two contractions until every component is a star around its smallest node. In the large step every node's larger
    neighbours are linked to the smallest of its neighbourhood, in the small step its smaller
    neighbours are. Both keep components and turn them into stars in a number of rounds that grows
    with the logarithm of their size. A node with very many neighbours is only ever a grouping key
    of a minimum (pre-aggregated by task) and of a join with its one-row result, which Spark can
    split. Each round is written below the checkpoint folder, so that lineage stays short; only the
    result stays there, in the scratch folder keep if one is given.
    Null nodes and self-loops are dropped; an empty table has no components."""
    links = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col("u") != F.col("v"))
    scratch = Scratch(edges.sparkSession)
    links = scratch.keep(links)
    n = links.count()
    while not stars(links, n):
        # Large step: link each larger neighbour to the minimum of the closed neighbourhood.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A link gives one row, repeated ones are dropped after the small step.
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
        # Small step: link a node's smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = few(small.select("e.u", F.col("e.m").alias("v")).where("u != v"), n)
        links = scratch.keep(few(small.distinct(), n))
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = few(links.select("v").distinct(), n).select(F.col("v").alias("node"), F.col("v").alias("component"))
    out = (keep.keep if keep else saved)(nodes.unionByName(centres))
    scratch.clear()
    return out


def extended(parts: DataFrame, links: DataFrame, src: str, dst: str, scratch: Scratch) -> DataFrame:
    """node, component of known components and further links. Only links between different components are contracted,
    with a component as one node, so what is known already is not gone through again."""
    name = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"__{c}"))
    ends = links.select(src, dst).join(name(src), src, "left").join(name(dst), dst, "left")
    ends = scratch.keep(ends.select(F.coalesce(f"__{src}", src).alias("a"), F.coalesce(f"__{dst}", dst).alias("b")).where("a != b").distinct())
    if ends.isEmpty():
        return parts
    across = connected_components(ends, "a", "b", scratch)
    moved = parts.join(across.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # The name of a component is one of its nodes.
    return scratch.keep(moved.unionByName(across.join(parts, "node", "left_anti")))


def chained(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """a, b: links that join all others of a key, the first one with each. For pairs with few others a key."""
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias("all"))
    return rows.select(F.element_at("all", 1).alias("a"), F.explode("all").alias("b")).where("a != b").distinct()

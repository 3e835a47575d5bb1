"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' content in a tree of, say, domain, language and source. Each node has a
weight among its siblings and a capacity: ``max_epochs`` times the tokens below it. The token budget
goes down level by level. A node's children first get shares by weight; a child that cannot use its
share is filled up and what it leaves goes to its siblings by their weights (filling to a common
level), so a shortage stays among siblings while any of them has room, and reaches the ancestors'
siblings only as the parent's own capacity. A leaf's budget buys whole epochs of its documents and
then a prefix, by tokens, of one more epoch in that epoch's seeded order (documents by the MD5 of
seed, epoch and id), taken while the running sum is within what is left.

Native. The order is never sorted as a whole: tokens are summed by the first three hexadecimal
digits of the order's key, then inside each leaf's one undecided bucket by the next three, and only
the rows of the last undecided bucket (one in 16 million of a leaf) are ranked, so a leaf with a
third of all rows still spreads over all tasks. Plans per leaf are broadcast up to a checked size.

Null levels count as ``?``; weights default to 1, and nodes of weight 0 or less get nothing. Rows
without words never are selected; a null id is ordered as the text ``null``; equal keys (repeated
rows) are ordered by tokens. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.materialize import materialized

#: Leaves up to this many are broadcast with their plan.
BROADCAST_LEAVES = 200_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes with ``budget``: their parents' ``parent_budget`` spread by ``weight``, at most ``capacity`` each."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy("level", name)
    upto, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    rows = nodes.where("weight > 0").withColumn("level", F.col("capacity") / F.col("weight"))
    # What all would use if each were filled to this node's level.
    used = F.sum("capacity").over(upto) + F.col("level") * F.coalesce(F.sum("weight").over(after), F.lit(0.0))
    rows = rows.withColumn("full", used <= F.col("parent_budget") + 1e-6)
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(by), F.lit(0.0))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    return rows.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise((F.col("parent_budget") - held) / free * F.col("weight"))).drop("level", "full", "parent_budget")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], budget: Column, max_epochs: int) -> DataFrame:
    """levels, tokens and leaf_budget of each leaf; leaves: levels and tokens (its documents' sum)."""
    nodes = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)

    def weight(level: str) -> Column:
        given = weights.get(level) or {}
        known = F.create_map(*[F.lit(x) for k, w in given.items() for x in (k, float(w))]) if given else None
        return F.coalesce(F.try_element_at(known, F.col(level)), F.lit(1.0)) if given else F.lit(1.0)

    # Nodes of weight 0 hold no capacity for their ancestors either.
    for level in levels:
        nodes = nodes.withColumn("capacity", F.when(weight(level) > 0, F.col("capacity")).otherwise(0.0))
    top = nodes.agg(F.least(F.first(budget), F.coalesce(F.sum("capacity"), F.lit(0.0))).alias("parent_budget")).first()
    above: DataFrame | None = None
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        here = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(level))
        if above is None:
            here = here.withColumn("parent_budget", F.lit(float(top[0] or 0.0)))
        else:
            here = here.join(above, path[:-1])
        spread = filled(here, path[:-1], level)
        above = spread.select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(above, list(levels)).select(*levels, "tokens", F.floor(F.round("parent_budget", 3)).alias("leaf_budget"))


def prefix_cut(sums: DataFrame, leaf: list[str], digits: str, rest: str, cut: str) -> DataFrame:
    """Per leaf: ``cut``, the first bucket that its rest does not cover, and ``rest`` less the buckets before."""
    upto = Window.partitionBy(*leaf).orderBy(digits).rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumn("run", F.sum("tokens").over(upto))
    over = run.where(F.col("run") > F.col(rest))
    first = over.groupBy(*leaf).agg(F.min_by(F.struct(F.col(digits).alias("d"), (F.col(rest) - (F.col("run") - F.col("tokens"))).alias("r")), digits).alias("x"))
    return first.select(*leaf, F.col("x.d").alias(cut), F.col("x.r").alias(f"{cut}_rest"))


def mix_sources(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, float]],
    share: float,
    max_epochs: int = 3,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The selection: key, the levels' columns, n_tokens, epoch (from 0) and leaf_budget, one row for
    each time a document is taken. The budget is ``share`` of all tokens; tokens are words."""
    names = list(levels)
    rows = docs.select(F.col(key), *[F.coalesce(c.cast("string"), F.lit("?")).alias(n) for n, c in levels.items()], count_words(F.col(text)).alias("n_tokens"))
    rows = materialized(rows.where("n_tokens > 0"))
    leaves = materialized(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
    total, n_leaves = leaves.agg(F.sum("tokens"), F.count("*")).first()
    small = F.broadcast if n_leaves <= BROADCAST_LEAVES else lambda x: x
    plan = leaf_budgets(leaves, names, weights, F.lit(float((total or 0) * share)), max_epochs)
    plan = materialized(plan.select(*names, "leaf_budget", F.expr("leaf_budget div tokens").alias("whole"), F.expr("leaf_budget % tokens").alias("rest")))

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    ranked = rows.join(small(plan), names).withColumn("order", order).withColumn("d1", F.substring("order", 1, 3)).withColumn("d2", F.substring("order", 4, 3))
    sums = ranked.groupBy(*names, "d1").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    cut1 = materialized(prefix_cut(sums, names, "d1", "rest", "cut1"))
    ranked = ranked.join(small(cut1), names, "left")
    inner = ranked.where(F.col("d1") == F.col("cut1")).groupBy(*names, "d2").agg(F.sum("n_tokens").alias("tokens"), F.first("cut1_rest").alias("cut1_rest"))
    cut2 = materialized(prefix_cut(inner, names, "d2", "cut1_rest", "cut2"))
    ranked = ranked.join(small(cut2), names, "left")
    undecided = (F.col("d1") == F.col("cut1")) & (F.col("d2") == F.col("cut2"))
    before = F.when(F.col("cut1").isNull(), True).otherwise((F.col("d1") < F.col("cut1")) | (F.col("d1") == F.col("cut1")) & F.coalesce(F.col("d2") < F.col("cut2"), F.lit(True)))
    kept = ["whole", "leaf_budget"]
    clear = ranked.where(~F.coalesce(undecided, F.lit(False))).select(key, *names, "n_tokens", *kept, before.alias("again"))
    last = Window.partitionBy(*names).orderBy("order", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    close = ranked.where(undecided).withColumn("run", F.sum("n_tokens").over(last)).select(key, *names, "n_tokens", *kept, (F.col("run") <= F.col("cut2_rest")).alias("again"))
    times = F.col("whole").cast("int") + F.when(F.col("again"), 1).otherwise(0)
    taken = clear.unionByName(close).withColumn("times", times).where("times > 0")
    return taken.select(key, *names, "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times").cast("long") - 1)).alias("epoch"), "leaf_budget")

"""Numbering and sampling by digests: the same rows at every partitioning, no task that sees them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.materialize import materialized, saved


def lot(seed: int, *parts: Column) -> Column:
    """A number below 2 ** 32 by the digest of the seed and the parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def placed(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``place``, from 0 in the given order, which should end in a unique column: ranks within range
    partitions plus what the partitions before hold."""
    # A row's number within its partition comes with its id, in which the partition's number is what lies above 33 bits.
    rows = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__p", F.shiftright("__id", 33))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    # One row for each partition.
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(before), "__p").withColumn("place", (F.col("__before") + within).cast("long")).drop("__p", "__id", "__before")


def running_sum(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over all earlier rows in the given order, which should end in
    a unique column: sums within range partitions plus what the partitions before hold."""
    rows = materialized(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sums = rows.groupBy("__p").agg(F.sum(value).alias("__n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    start = sums.select("__p", F.coalesce(F.sum("__n").over(earlier(Window.orderBy("__p"))), F.lit(0)).alias("__start"))
    within = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("__p").orderBy(*order))), F.lit(0))
    return rows.join(F.broadcast(start), "__p").withColumn("before", F.col("__start") + within).drop("__p", "__start")


def running_max(df: DataFrame, value: str, *order: str) -> DataFrame:
    """Adds ``highest``, the greatest ``value`` (null first) of all earlier rows in the given order, which should
    end in a unique column: maxima within range partitions and of the partitions before."""
    rows = materialized(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    tops = rows.groupBy("__p").agg(F.max(value).alias("__n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition.
    start = tops.select("__p", F.max("__n").over(earlier(Window.orderBy("__p"))).alias("__start"))
    within = F.max(value).over(earlier(Window.partitionBy("__p").orderBy(*order)))
    found = rows.join(F.broadcast(start), "__p").withColumn("__within", within)
    return found.withColumn("highest", F.greatest("__start", "__within")).drop("__p", "__start", "__within")


#: Steps from a group's highest score to its lowest.
STEPS = 4096
#: Groups whose bounds are broadcast.
GROUPS = 200_000


def best(rows: DataFrame, limits: DataFrame, group: str, score: str, *ties: str, expand: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The k rows of each group with the highest scores (finite numbers), ties in the order of the tie columns,
    which should end in a unique one. limits: group, k. rows are read some times over, so they should be cheap.

    Where the rows are made from fewer ones, give those and ``expand``, which makes them and keeps columns that start
    with ``__``: a group's bounds then meet the few, and what is made is filtered where it is made.

    The rows of a group are counted by steps of equal width between its highest and lowest score. What lies
    above the step in which the k-th row falls is taken by a comparison; that step's rows alone are sorted,
    by numbers over range partitions. So no group is ever ranked in one task."""
    s = F.col(score).cast("double")
    columns = expand(rows).columns
    bounds = expand(rows).groupBy(group).agg(F.min(s).alias("__lo"), F.max(s).alias("__hi")).join(limits.select(group, F.col("k").alias("__k")), group)
    bounds = materialized(bounds)
    # A row for each group: broadcast if they are few. The rows themselves never are, whatever Spark takes their size for.
    by_group = F.broadcast if bounds.count() <= GROUPS else lambda df: df.hint("merge")
    step = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.floor((F.col("__hi") - s) * (STEPS - 1) / (F.col("__hi") - F.col("__lo")))).cast("int")
    bounded = rows.join(by_group(bounds), group)
    dealt = expand(bounded).withColumn("__step", step)
    counts = dealt.groupBy(group, "__step").agg(F.count("*").alias("__n"), F.first("__k").alias("__k"))
    # At most STEPS rows a group.
    upto = F.sum("__n").over(Window.partitionBy(group).orderBy("__step").rowsBetween(Window.unboundedPreceding, 0))
    over = counts.withColumn("__upto", upto).where(F.col("__upto") > F.col("__k"))
    edge = over.groupBy(group).agg(F.min(F.struct("__step", (F.col("__k") - F.col("__upto") + F.col("__n")).alias("left"))).alias("__e")).select(group, F.col("__e.__step").alias("__edge"), F.col("__e.left").alias("__left"))
    judged = expand(bounded.join(by_group(materialized(edge)), group, "left")).withColumn("__step", step)
    sure = judged.where(F.col("__edge").isNull() | (F.col("__step") < F.col("__edge"))).select(*columns)
    last = placed(judged.where(F.col("__step") == F.col("__edge")).withColumn("__down", -s).select(*columns, "__left", "__down"), group, "__down", *ties)
    last = materialized(last)
    first = last.groupBy(group).agg(F.min("place").alias("__first"))
    chosen = last.join(by_group(first), group).where(F.col("place") - F.col("__first") < F.col("__left"))
    return sure.unionByName(chosen.select(*columns))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``place``: the rows in an order by digests, ties by key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return placed(df.withColumn("__digest", digest), "__digest", key).drop("__digest")


def bernoulli(df: DataFrame, name: Column, share: float, seed: int = 0) -> DataFrame:
    """Each row with a probability of share, by the digest of its name."""
    return df.where(lot(seed, name) < int(2**32 * share))


def negative_pairs(mentions: DataFrame, mention: str, cluster: str, draws: int, seed: int = 0) -> DataFrame:
    """a, b (the lesser mention first): pairs of different clusters, at most ``draws``.

    Each draw takes two clusters, then one mention of each. Mentions are numbered cluster by cluster, so
    that a draw is a sum and a mention is found by an equi-join on its number, however large its
    cluster is. Draws of one cluster twice and repeated pairs are dropped."""
    rows = materialized(placed(mentions.select(F.col(cluster).alias("cluster"), F.col(mention).alias("mention")), "cluster", "mention"))
    groups = rows.groupBy("cluster").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    groups = materialized(placed(groups, "cluster"))
    n_groups = groups.count()
    if n_groups < 2:
        return rows.select(F.col("mention").alias("a"), F.col("mention").alias("b")).limit(0)
    d = mentions.sparkSession.range(draws).select(F.col("id").alias("draw"))
    d = d.select("draw", *[(lot(seed, F.col("draw"), F.lit(x)) % n_groups).alias(f"c{x}") for x in "ab"]).where("ca != cb")
    for side, salt in (("a", "c"), ("b", "d")):
        g = groups.select(F.col("place").alias(f"c{side}"), "start", "n")
        d = d.join(g, f"c{side}").withColumn(f"p{side}", F.col("start") + lot(seed, F.col("draw"), F.lit(salt)) % F.col("n")).drop("start", "n")
    for side in "ab":
        d = d.join(rows.select(F.col("place").alias(f"p{side}"), F.col("mention").alias(f"m{side}")), f"p{side}")
    return d.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()

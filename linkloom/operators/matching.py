"""One-to-one assignment of spans by overlap, and alignment of a text with a longer version of it."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b, width, at, side: the spans of a and b (id, start, end, exclusive) that share tokens.

    Neither side's spans overlap each other. Of two spans that meet, the later one starts in the other,
    which is the last of its side before it: one window over both sides finds every pair, at most one
    for each span."""
    rows = a.select(*keys, "id", "start", "end", F.lit(0).alias("side")).unionByName(b.select(*keys, "id", "start", "end", F.lit(1).alias("side")))
    before = Window.partitionBy(*keys).orderBy("start", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("side") == s, F.struct("id", "end")), ignorenulls=True).over(before).alias(f"last{s}") for s in (0, 1)]
    seen = rows.where("start < end").select("*", *last).withColumn("other", F.when(F.col("side") == 0, F.col("last1")).otherwise(F.col("last0")))
    met = seen.where("other.end > start")
    ids = [F.when(F.col("side") == s, F.col("id")).otherwise(F.col("other.id")).alias(n) for s, n in ((0, "a"), (1, "b"))]
    return met.select(*keys, *ids, (F.least("end", "other.end") - F.col("start")).cast("long").alias("width"), F.col("start").alias("at"), "side")


def matched_spans(a: DataFrame, b: DataFrame, keys: Sequence[str], keep_a: bool = False) -> DataFrame:
    """keys, a, b: the one-to-one assignment of greatest total overlap; ``keep_a`` adds unmatched spans of
    a with a null b.

    In order of place, pairs exclude each other only in runs that share a span, so the best total up to
    a pair is either the one before it or its own width and the best total before its run: a fold over
    each chain of interlocking spans. Of equal totals the one of earlier pairs is kept."""
    order = Window.partitionBy(*keys).orderBy("at", "side")
    pairs = overlaps(a, b, keys).withColumn("shares", F.when(F.lag("a").over(order) == F.col("a"), "a").when(F.lag("b").over(order) == F.col("b"), "b").otherwise(""))
    chained = pairs.withColumn("chain", F.sum(F.when(F.col("shares") == "", 1).otherwise(0)).over(order))
    chains = chained.groupBy(*keys, "chain").agg(F.array_sort(F.collect_list(F.struct("at", "side", "a", "b", "width", "shares"))).alias("pairs"))
    none = lambda: F.array().cast("array<int>")
    zero = lambda: F.lit(0).cast("long")
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("run"), *[c for n in ("best", "before", "base") for c in (zero().alias(n), none().alias(f"{n}_of"))])

    def step(s: Column, x: Column) -> Column:
        same = s["run"] == x["shares"]
        base, base_of = F.when(same, s["base"]).otherwise(s["before"]), F.when(same, s["base_of"]).otherwise(s["before_of"])
        better = base + x["width"] > s["best"]
        best, best_of = F.when(better, base + x["width"]).otherwise(s["best"]), F.when(better, F.concat(base_of, F.array(s["i"]))).otherwise(s["best_of"])
        return F.struct((s["i"] + 1).alias("i"), x["shares"].alias("run"), best.alias("best"), best_of.alias("best_of"), s["best"].alias("before"), s["best_of"].alias("before_of"), base.alias("base"), base_of.alias("base_of"))

    chosen = F.aggregate("pairs", start, step, lambda s: s["best_of"])
    found = chains.select(*keys, F.explode(F.transform(chosen, lambda i: F.get("pairs", i))).alias("p")).select(*keys, "p.a", "p.b")
    return a.select(*keys, F.col("id").alias("a")).join(found, [*keys, "a"], "left") if keep_a else found


def places_in(original: str | None, longer: str | None) -> list[int | None] | None:
    """For every character of ``longer`` its place in ``original``, None if it was put in between."""
    if original is None or longer is None:
        return None
    at, out = 0, []
    for c in longer:
        hit = at < len(original) and c == original[at]
        out.append(at if hit else None)
        at += hit
    return out if at == len(original) else None


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def aligned(original: pd.Series, longer: pd.Series) -> pd.Series:
    """Places of the characters of ``longer``, which has all of ``original`` in order and more in between.

    Each character takes the first place that is left. Null where either text is null or ``longer``
    lacks a character. A running place has no built-in expression of linear time."""
    return pd.Series([places_in(o, t) for o, t in zip(original, longer)], dtype=object)

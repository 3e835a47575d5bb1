"""Coreference and classification metrics from contingency counts.

Clusterings are rows (doc, mention, cluster); every metric is a sum of per-document numerators and
denominators that are divided at the end. Precision reads the system as input, recall the key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.components import connected_components
from linkloom.operators.materialize import materialized, saved


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def sized(clusters: DataFrame) -> DataFrame:
    """doc, cluster, size of clusterings, or of what is that already."""
    return clusters if "size" in clusters.columns else clusters.groupBy("doc", "cluster").agg(F.count("*").alias("size"))


def contingency(key: DataFrame, system: DataFrame, sizes: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """doc, k, s, n, nk, ns: shared mentions of each pair of clusters that share any, and both sizes (`sized`)."""
    nk, ns = sizes or (sized(key), sized(system))
    both = key.select("doc", "mention", F.col("cluster").alias("k")).join(system.select("doc", "mention", F.col("cluster").alias("s")), ["doc", "mention"])
    cells = both.groupBy("doc", "k", "s").agg(F.count("*").alias("n"))
    return cells.join(nk.toDF("doc", "k", "nk"), ["doc", "k"]).join(ns.toDF("doc", "s", "ns"), ["doc", "s"])


def per_side(cells: DataFrame, clusters: DataFrame, side: str, metric: str) -> DataFrame:
    """doc, num, den of one metric with the clusters of one side (``k`` or ``s``) as input."""
    size = "nk" if side == "k" else "ns"
    sizes = sized(clusters).withColumnRenamed("cluster", side)
    if metric == "mentions":
        got = cells.groupBy("doc").agg(F.sum("n").alias("num"))
        total = sizes.groupBy("doc").agg(F.sum("size").alias("den"))
        return total.join(got, "doc", "left").select("doc", F.coalesce("num", F.lit(0)).cast("double").alias("num"), F.col("den").cast("double").alias("den"))
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    if metric == "muc":
        part, den = F.sum(F.col("n") - 1), F.col("size") - 1
    elif metric == "b3":
        part, den = F.sum(F.col("n") * F.col("n") / F.col(size)), F.col("size")
    elif metric == "lea":
        # Links in common over all links, weighted by size; singletons match singletons only.
        alone = F.max(F.when((F.col(size) == 1) & (F.col("nk") == F.col("ns")), 1.0).otherwise(0.0))
        part = F.when(F.max(size) == 1, alone).otherwise(F.max(size) * F.sum(pairs("n")) / F.max(F.when(F.col(size) > 1, pairs(size)).otherwise(1)))
        den = F.col("size")
    else:
        raise ValueError(metric)
    parts = cells.groupBy("doc", side).agg(part.alias("part"))
    rows = sizes.join(parts, ["doc", side], "left")
    return rows.groupBy("doc").agg(F.sum(F.coalesce("part", F.lit(0)).cast("double")).alias("num"), F.sum(den).cast("double").alias("den"))


def by_document(key: DataFrame, system: DataFrame, metric: str, cells: DataFrame | None = None) -> DataFrame:
    """doc, p_num, p_den, r_num, r_den. cells: their contingency, if it is there already; key and system may then be
    their sizes."""
    if cells is None:
        sizes = saved(sized(key)), saved(sized(system))
        cells = saved(contingency(key, system, sizes))
        key, system = sizes
    r, p = (per_side(cells, c, side, metric) for c, side in ((key, "k"), (system, "s")))
    return p.select("doc", F.col("num").alias("p_num"), F.col("den").alias("p_den")).join(r.select("doc", F.col("num").alias("r_num"), F.col("den").alias("r_den")), "doc", "full").fillna(0.0)


def summed(scores: DataFrame) -> DataFrame:
    """precision, recall, f1 over all documents."""
    t = scores.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("p_num", "p_den", "r_num", "r_den")])
    rows = t.select(ratio(F.col("p_num"), F.col("p_den")).alias("precision"), ratio(F.col("r_num"), F.col("r_den")).alias("recall"))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def assigned(weight: np.ndarray) -> float:
    """The largest total of a one-to-one assignment of rows to columns (shortest augmenting paths)."""
    if weight.shape[0] > weight.shape[1]:
        weight = weight.T
    n, m = weight.shape
    cost = weight.max(initial=0) - weight
    row_of, u, v = np.full(m + 1, -1), np.zeros(n), np.zeros(m + 1)
    for i in range(n):
        row_of[m], j = i, m
        least, before, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            open_ = np.flatnonzero(~done[:m])
            slack = cost[r, open_] - u[r] - v[open_]
            better = slack < least[open_]
            least[open_[better]], before[open_[better]] = slack[better], j
            k = open_[least[open_].argmin()]
            step = least[k]
            used = np.flatnonzero(done)
            u[row_of[used]] += step
            v[used] -= step
            least[open_] -= step
            j = k
        while j != m:
            row_of[j] = row_of[before[j]]
            j = before[j]
    at = np.flatnonzero(row_of[:m] >= 0)
    return float(weight[row_of[at], at].sum())


def ceaf(key: DataFrame, system: DataFrame, entity: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """doc, p_num, p_den, r_num, r_den of CEAF: the best one-to-one matching of clusters, by
    ``2n / (|k| + |s|)`` and numbers of clusters, or by n and numbers of mentions.

    Clusters that share no mention have weight 0, so each connected part of a document's sparse
    matching is solved by itself. A pair of clusters that meet no others is a part with one solution
    and stays in the JVM; the rest is solved in Python, part by part. Where all clusters of a large
    document hang together its part is one group: a matrix of its clusters on either side."""
    if cells is None:
        sizes = saved(sized(key)), saved(sized(system))
        cells = saved(contingency(key, system, sizes))
        key, system = sizes
    for c in "ks":
        several = cells.groupBy("doc", c).agg((F.count("*") == 1).alias(f"one_{c}"))
        cells = cells.join(several, ["doc", c])
    cells = cells.withColumn("alone", F.col("one_k") & F.col("one_s")).drop("one_k", "one_s")
    weight = 2 * F.col("n") / (F.col("nk") + F.col("ns")) if entity else F.col("n").cast("double")
    single = cells.where("alone").groupBy("doc").agg(F.sum(weight).alias("num"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k, s = pd.factorize(rows["k"])[0], pd.factorize(rows["s"])[0]
        w = np.zeros((k.max() + 1, s.max() + 1))
        w[k, s] = 2 * rows["n"] / (rows["nk"] + rows["ns"]) if entity else rows["n"]
        return pd.DataFrame({"doc": [rows["doc"].iloc[0]], "num": [assigned(w)]})

    schema = key.select("doc").schema.add("num", "double")
    rest = cells.where("NOT alone").drop("alone").withColumn("node", F.xxhash64("doc", F.lit("k"), "k"))
    parts = connected_components(rest.select("node", F.xxhash64("doc", F.lit("s"), "s").alias("other")), "node", "other")
    solved = rest.join(parts, "node").groupBy("doc", "component").applyInPandas(run, schema)
    best = single.unionByName(solved).groupBy("doc").agg(F.sum("num").alias("num"))
    count = F.count("*") if entity else F.sum("size")
    k = sized(key).groupBy("doc").agg(count.cast("double").alias("r_den"))
    s = sized(system).groupBy("doc").agg(count.cast("double").alias("p_den"))
    rows = k.join(s, "doc", "full").join(best, "doc", "left").fillna(0.0)
    return rows.select("doc", F.col("num").alias("p_num"), "p_den", F.col("num").alias("r_num"), "r_den")


#: The metrics of a report, and those whose F1 the CoNLL score averages.
METRICS = ("mentions", "muc", "b3", "ceafe", "ceafm", "lea")
CONLL = ("muc", "b3", "ceafe")


def report(key: DataFrame, system: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """metric, precision, recall, f1 over all documents, and a row ``conll`` whose f1 is the mean of those of
    MUC, B-cubed and CEAF by entities (null if one isn't asked for). The contingency is computed once."""
    sizes = saved(sized(key)), saved(sized(system))
    cells = saved(contingency(key, system, sizes))
    rows = []
    for name in names:
        scores = ceaf(*sizes, name == "ceafe", cells) if name.startswith("ceaf") else by_document(*sizes, name, cells)
        rows.append(summed(scores).select(F.lit(name).alias("metric"), "precision", "recall", "f1"))
    every = materialized(reduce(DataFrame.unionByName, rows))
    asked = F.when(F.count_if(F.col("metric").isin(*CONLL)) == len(CONLL), F.avg(F.when(F.col("metric").isin(*CONLL), F.col("f1"))))
    none = F.lit(None).cast("double")
    return every.unionByName(every.agg(asked.alias("f1")).select(F.lit("conll").alias("metric"), none.alias("precision"), none.alias("recall"), "f1"))


def conll(key: DataFrame, system: DataFrame) -> DataFrame:
    """conll: 100 times the mean F1 of MUC, B-cubed and CEAF by entities."""
    return report(key, system, CONLL).where("metric = 'conll'").select((100 * F.col("f1")).alias("conll"))


def binary(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of 0/1 predictions."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    c = rows.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumns({"f1": f1(F.col("precision"), F.col("recall")), "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def set_overlap(key: DataFrame, system: DataFrame) -> DataFrame:
    """precision, recall, f1 of two sets of (doc, mention), such as non-referring mentions."""
    both = key.select("doc", "mention", F.lit(1).alias("k")).join(system.select("doc", "mention", F.lit(1).alias("s")), ["doc", "mention"], "full")
    t = both.agg(F.count_if(F.col("k").isNotNull() & F.col("s").isNotNull()).alias("n"), F.count("k").alias("nk"), F.count("s").alias("ns"))
    rows = t.select(ratio(F.col("n"), F.col("ns")).alias("precision"), ratio(F.col("n"), F.col("nk")).alias("recall"))
    return rows.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def mean_and_deviation(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and sample deviation over seeds (0 for a single one)."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def harmonic_mean(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    return scores.where(F.col(value) > 0).groupBy(*keys).agg((F.count("*") / F.sum(1 / F.col(value))).alias("harmonic_mean"))


def with_copies(scores: DataFrame, of: Column, column: str, value: str) -> DataFrame:
    """The scores and, again, those that ``of`` holds for, with another value in a column."""
    return scores.unionByName(scores.where(of).withColumn(column, F.lit(value)))

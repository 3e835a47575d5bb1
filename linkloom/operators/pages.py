"""Page index operators: which captures and pages stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text, urls


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key: the least by the order's columns, of which nulls come first and which
    should end in a unique one. A minimum of structs, pre-aggregated by task, so keys of any number of
    rows stay spread."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)]))
    return df.groupBy(*keys).agg(least.alias("__first")).select(*keys, "__first.*").select(*df.columns)


def with_normalized(df: DataFrame, url: str = "url", out: str = "url_normalized") -> DataFrame:
    """Adds the page key; rows whose URL has no host are dropped."""
    return df.where(urls.netloc(F.col(url)) != "").withColumn(out, urls.normalized(F.col(url)))


def oldest_captures(index: DataFrame, key: Column, timestamp: str, tie: str) -> DataFrame:
    return keep_first(index.withColumn("__key", key), ["__key"], [F.col(timestamp).isNull(), F.col(timestamp), F.col(tie)]).drop("__key")


def longest_pages(pages: DataFrame, key: str, length: str, tie: str) -> DataFrame:
    return keep_first(pages, [key], [F.col(length).isNull(), -F.col(length), F.col(tie)])


def without_prefixes(df: DataFrame, url: Column, prefixes: Sequence[str]) -> DataFrame:
    return df.where(~text.any_of([F.startswith(url, F.lit(p)) for p in prefixes]))


def substring_filter(df: DataFrame, url: Column, blacklist: Sequence[str] = (), whitelist: Sequence[str] = ()) -> DataFrame:
    """Drops what the blacklist matches and the whitelist doesn't. Without a blacklist everything counts
    as blacklisted, so that a whitelist alone keeps just its own matches."""
    black = text.any_of([F.contains(url, F.lit(b)) for b in blacklist]) if blacklist else F.lit(True)
    white = text.any_of([F.contains(url, F.lit(w)) for w in whitelist])
    return df.where(~(black & ~white))


def rewrite_prefix(url: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(url, F.lit(old)), F.concat(F.lit(new), F.substring(url, F.lit(len(old) + 1), F.length(url)))).otherwise(url)


def best_of_cluster(clustering: DataFrame, pages: DataFrame, key: str, degrees: DataFrame, length: str) -> DataFrame:
    """The page of each cluster with most in-links, then out-links, then characters, then by key."""
    joined = clustering.join(pages.select(key, length), key).join(degrees, key, "left").fillna(0, ["in_degree", "out_degree"])
    order = [-F.col("in_degree"), -F.col("out_degree"), F.col(length).isNull(), -F.col(length), F.col(key)]
    return keep_first(joined, ["cluster"], order)

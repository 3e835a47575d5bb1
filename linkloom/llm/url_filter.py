"""URL filtering by hashed host-suffix and path-prefix expressions.

A URL stands for the expressions host-suffix + path-prefix: the runs of trailing labels of its host,
with the prefixes of its path, of the numbers of labels and lengths that some rule has. Rules and
expressions meet in an equi-join on the first four bytes of their SHA-256 alone: rules are grouped by
these bytes. Of a group that an expression meets only rules with its full digest are confirmed, and
precedence picks one: the longest host and path together, then the longest host, then block before
allow. Rules therefore fit their host and all subdomains when the URL's path starts with the rule's,
and a URL is never compared with rules it shares no hash prefix with.

Where no rule fits, the verdict is ``default``. Null URLs and URLs without ``://`` have an empty host
and path and match nothing. Repeated rows stay repeated, null keys too; an empty table gives an empty
result, no rules leave every row its default. A very long URL has no more expressions than the rules
have pairs of label numbers and lengths. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of up to so many bytes are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then
    up to ``?``, ``#`` or the end; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def hashed(expressions: DataFrame, column: str) -> DataFrame:
    """Adds the full digest and the short hash prefix of an expression."""
    digest = F.sha2(F.col(column), 256)
    return expressions.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """The lookup table: verdict, rule text, its precedence, digest and short hash prefix."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().distinct()
    return hashed(rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("n_host"), F.length("path").alias("n_path"), F.size(F.split("host", r"\.")).alias("n_labels"), F.concat("host", F.lit("\n"), "path").alias("key")), "key").drop("key")


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """key, host, path, rule (null where none fits) and verdict of every row.

    rules: (verdict, host, path) tuples, verdicts ``allow`` or ``block``, or a DataFrame of these
    columns of any size."""
    lookup = rule_table(pages.sparkSession, rules)
    # How large the rules are, and their label numbers and path lengths: aggregates of the rules alone.
    held, labels, lengths = lookup.agg(F.sum(F.octet_length("rule") + 200), F.collect_set("n_labels"), F.collect_set("n_path")).first()
    best = F.struct((F.col("n_host") + F.col("n_path")).alias("n"), "n_host", (F.col("verdict") == "block").alias("block"), "rule", "verdict")
    lookup = lookup.groupBy(F.col("short").alias("prefix")).agg(F.collect_list(F.struct("digest", best.alias("rule"))).alias("rules"))
    if (held or 0) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    # Equal URLs are judged once, so that repeats and null keys need no row number.
    urls = rows.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    numbers = lambda values, most: F.filter(F.array(*[F.lit(n) for n in sorted(values)]).cast("array<int>"), lambda n: n <= most)
    suffixes = F.transform(numbers(labels, F.size("labels")), lambda n: F.array_join(F.slice("labels", -n, n), "."))
    prefixes = F.transform(numbers(lengths, F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    urls = urls.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes"))
    urls = urls.select("host", "path", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = hashed(urls.select("host", "path", F.concat("suffix", F.lit("\n"), "prefix").alias("expression")), "expression").drop("expression")
    met = expressions.join(lookup, F.col("short") == F.col("prefix"))
    confirmed = met.withColumn("rule", F.array_max(F.transform(F.filter("rules", lambda r: r["digest"] == F.col("digest")), lambda r: r["rule"]))).where(F.col("rule").isNotNull())
    judged = confirmed.groupBy("host", "path").agg(F.max("rule").alias("best"))
    return rows.join(judged, ["host", "path"], "left").select(
        F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )

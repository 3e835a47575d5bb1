"""Benchmark decontamination by size-partitioned MinHash containment search.

A benchmark item leaks into a document when at least ``threshold`` of the item's distinct shingles
(five consecutive lower-cased words; an item of fewer words is one shingle of all its words) occur
in the document. Items are partitioned by size, shingle counts from a power of two to the next. In
the partition with most shingles u, an item's sketch is its ``floor((1 - threshold) * u) + 1``
smallest shingle hashes. A leak can miss at most ``(1 - threshold) * u`` of an item's shingles, so
one of the sketch is always in the document: the search has no false negatives, however short the
item or long the document. Documents contribute only shingles whose hash is small enough to be in
some sketch. What shares a sketch hash is a candidate; candidates are verified by exact containment
of the shingle strings, row by row, so copies never meet in one task.

Native. Null or empty texts and items have no shingles and never match; null ids are carried along;
an empty benchmark leaves every document; repeated rows are judged alike. `decontaminate` keeps all
columns; its helper columns start with ``__``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.materialize import materialized

WIDTH = 5
THRESHOLD = 0.8
#: Sides of joins of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def windows(words: str, width: int, of) -> Column:
    """of(window) for every run of ``width`` words; none if there are fewer."""
    n = F.size(words) - (width - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: of(F.slice(words, i, width)))).otherwise(F.array())


def small(df: DataFrame, held: Column) -> DataFrame:
    """df with a broadcast hint if its rows hold few bytes in all; df must be cheap to read."""
    return F.broadcast(df) if (df.agg(F.sum(held)).first()[0] or 0) <= BROADCAST_BYTES else df


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, width, shingles (distinct strings) of every item that has any."""
    rows = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(WIDTH))
    strings = F.transform(F.sequence(F.lit(1), F.size("words") - width + 1), lambda i: F.array_join(F.slice("words", i, width), " "))
    return rows.select("item_id", width.alias("width"), F.array_distinct(strings).alias("shingles"))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """h, item_id, width: the smallest hashes of each item, as many as its size partition needs."""
    hashed = items.select("item_id", "width", F.array_sort(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(F.split(s, " "))))).alias("hashes"), F.size("shingles").alias("n"))
    part = F.floor(F.log2(F.col("n").cast("double")))
    upper = F.pow(F.lit(2.0), part + 1) - 1
    need = F.floor((1 - F.lit(threshold)) * upper + 1e-9).cast("int") + 1
    return hashed.select("item_id", "width", F.explode(F.slice("hashes", F.lit(1), need)).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, text: str, threshold: float) -> DataFrame:
    """__key (of a text), width and item_id of each item that may leak into it."""
    sketch = materialized(sketches(items, threshold))
    widths, limit = items.agg(F.collect_set("width")).first()[0], sketch.agg(F.max("h")).first()[0]
    rows = docs.select(F.md5(F.col(text)).alias("__key"), words_of(F.col(text)).alias("words"))
    hashes = F.concat(*[windows("words", w, F.xxhash64) for w in sorted(widths)]) if widths else F.array()
    probes = rows.select("__key", F.explode(F.filter(hashes.cast("array<bigint>"), lambda h: h <= F.lit(limit).cast("long"))).alias("h"))
    # Rows that share an item id, or have none, may differ in width: each is verified in its own.
    met = probes.join(small(sketch, F.lit(64)), "h").select("__key", "item_id", "width").distinct()
    return materialized(met.groupBy("__key").agg(F.collect_list(F.struct("item_id", "width")).alias("__items")))


def verified(rows: DataFrame, found: DataFrame, items: DataFrame, text: str, threshold: float) -> DataFrame:
    """rows that are candidates, one for each item that does leak, with item_id, n_item and n_shared.

    Each row's shingles are computed below the expansion into items, hence once."""
    met = rows.withColumn("__key", F.md5(F.col(text))).join(small(found, 100 + 48 * F.size("__items")), "__key").withColumn("__words", words_of(F.col(text)))
    for w in range(1, WIDTH + 1):
        used = F.array_contains(F.transform("__items", lambda x: x["width"]), w)
        met = met.withColumn(f"__s{w}", F.when(used, F.array_distinct(windows("__words", w, lambda s: F.array_join(s, " ")))))
    pairs = met.drop("__words").withColumn("__item", F.explode("__items"))
    known = small(items, F.octet_length(F.array_join("shingles", "")) + 32 * F.size("shingles")).select(F.col("item_id").alias("__id"), F.col("width").alias("__width"), "shingles")
    pairs = pairs.join(known, F.col("__item.item_id").eqNullSafe(F.col("__id")) & (F.col("__item.width") == F.col("__width")))
    own = F.coalesce(*[F.when(F.col("__width") == w, F.col(f"__s{w}")) for w in range(1, WIDTH + 1)])
    n_item, n_shared = F.size("shingles").cast("long"), F.size(F.array_intersect("shingles", own)).cast("long")
    pairs = pairs.withColumns({"item_id": F.col("__id"), "n_item": n_item, "n_shared": n_shared})
    return pairs.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """keys, item_id, n_item, n_shared and containment of every document and item that leaks into it."""
    rows = docs.select(*dict.fromkeys((*keys, text)))
    items = materialized(item_shingles(benchmark, item_id, item_text))
    found = candidates(rows, items, text, threshold)
    renamed = rows.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(text).alias("__text"))
    leaks = verified(renamed, found, items, "__text", threshold).select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "item_id", "n_item", "n_shared")
    return leaks.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, into which no benchmark item leaks."""
    items = materialized(item_shingles(benchmark, item_id, item_text))
    found = candidates(docs.select(text), items, text, threshold)
    leaky = verified(docs.select(F.col(text).alias("__text")), found, items, "__text", threshold).select(F.col("__key").alias("leak")).distinct()
    # Whole rows travel as one column, so that no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.md5(F.col(text)).alias("own"))
    leaky = small(materialized(leaky), F.lit(64))
    return rows.join(leaky, F.col("own") == F.col("leak"), "left_anti").select("row.*")

"""Bounded samples of labelled texts, on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, max_bytes: int, key: str = "doc_id", text: str = "text") -> tuple[list[str], list[int]]:
    """(texts, labels) of about ``rows`` usable labelled documents of at most ``max_bytes`` bytes.

    ``usable`` is a condition on ``key``. Labels are drawn by a hash of the key before they meet the
    texts, so the joined side has about ``rows`` rows whatever the corpus holds and only their texts
    move. Null keys and labels are left out; of conflicting labels the larger counts; equal texts
    count once. The order follows the texts' hashes, so the fit doesn't depend on partitioning."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("label"))
    total = known.count()
    if total == 0:
        return [], []
    share = min(1.0, rows / total)
    drawn = known.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(2**32)) < int(share * 2**32))
    texts = docs.select(F.col(key), F.col(text).alias("text")).where(F.octet_length("text") <= max_bytes)
    found = texts.join(F.broadcast(drawn), key).groupBy("text").agg(F.max("label").alias("label"))
    picked = found.select("text", "label", F.xxhash64("text").alias("h")).toArrow().sort_by([("h", "ascending"), ("text", "ascending")])
    return picked.column("text").to_pylist(), picked.column("label").to_pylist()

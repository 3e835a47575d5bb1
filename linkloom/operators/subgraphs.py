"""Small pieces of the link graph for reading: targets of some links, their text, and every link's context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks around the anchor in its context.
OPEN, CLOSE = ">>>", "<<<"


def targets(links: DataFrame, target: str, low: int, high: int, texts: DataFrame | None = None) -> DataFrame:
    """target, n of those with low to high links; with texts, only of those that have one."""
    found = links.groupBy(target).agg(F.count("*").alias("n")).where(F.col("n").between(low, high))
    return found if texts is None else found.join(texts.select(target), target, "left_semi")


def contexts(links: DataFrame, sentences: DataFrame, key: str, reach: int = 1) -> DataFrame:
    """links with ``text``: the sentence of each link with its anchor marked, and up to ``reach`` sentences of the
    page before and after it. A link without its sentence goes; missing neighbours are left out.

    Each link asks for its neighbours by number, so a page is never gathered: a row for each of them."""
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("__step")
    numbered = links.withColumn("__link", F.struct(*links.columns))
    asked = numbered.select("__link", F.col(key).alias("__page"), F.col("sentence_idx").alias("__idx"), "chars_start", "chars_end", steps)
    said = sentences.select(F.col(key).alias("__page"), F.col("sentence_idx").alias("__at"), "sentence")
    rows = asked.withColumn("__at", F.col("__idx") + F.col("__step")).join(said, ["__page", "__at"])
    cut = lambda start, length: F.substring("sentence", start, length)
    marked = F.concat(cut(F.lit(1), F.col("chars_start")), F.lit(OPEN), cut(F.col("chars_start") + 1, F.col("chars_end") - F.col("chars_start")), F.lit(CLOSE), F.expr("substring(sentence, chars_end + 1)"))
    shown = rows.withColumn("__text", F.when(F.col("__step") == 0, marked).otherwise(F.col("sentence")))
    each = shown.groupBy("__link").agg(F.array_sort(F.collect_list(F.struct("__step", "__text"))).alias("__t"), F.count_if(F.col("__step") == 0).alias("__own"))
    return each.where("__own > 0").select("__link.*", F.array_join(F.col("__t.__text"), " ").alias("text"))


def export(links: DataFrame, sentences: DataFrame, texts: DataFrame, key: str, target: str, low: int = 3, high: int = 5, reach: int = 1, known: bool = False) -> DataFrame:
    """target, kind (``target`` or ``anchor-context``), doc, place (the sentence's number, -1 for a target), text.

    links: key, target, sentence_idx, chars_start, chars_end; sentences: key, sentence_idx, sentence; texts:
    target, doc, text of the pages that were scraped. known: only of targets that were."""
    chosen = targets(links, target, low, high, texts if known else None)
    found = contexts(links.join(chosen.select(target), target, "left_semi"), sentences, key, reach)
    around = found.select(F.col(target).alias("target"), F.lit("anchor-context").alias("kind"), F.col(key).alias("doc"), F.col("sentence_idx").cast("long").alias("place"), "text")
    own = texts.join(chosen.select(target), target, "left_semi").select(F.col(target).alias("target"), F.lit("target").alias("kind"), "doc", F.lit(-1).cast("long").alias("place"), "text")
    return around.unionByName(own)

"""Keeping pages, sentences, links and tokens consistent with each other after filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators.sentences import renumbered


def with_sentences(links: DataFrame, sentences: DataFrame, key: str, idx: str = "sentence_idx", how: str = "left") -> DataFrame:
    """Links with the sentence they stand in: all links (``left``, null where there is none), or only
    those that have one (``inner``)."""
    return links.join(sentences.select(key, idx, "sentence"), [key, idx], how)


def anchors(links: DataFrame, sentences: DataFrame, key: str, idx: str = "sentence_idx", start: str = "chars_start", end: str = "chars_end") -> DataFrame:
    """Adds ``anchor``, the text of each link's span; links without a sentence go."""
    found = with_sentences(links, sentences, key, idx, "inner")
    return found.withColumn("anchor", F.substring("sentence", F.col(start) + 1, F.col(end) - F.col(start))).drop("sentence")


def blacklisted(column: Column, patterns: Sequence[str]) -> Column:
    """Whether a pattern matches the sentence at its start or the sentence reads like a CSV null."""
    return text.starts_with_any(column, patterns) | F.lower(column).isin(*text.NULL_LITERALS)


def without_blacklisted(sentences: DataFrame, links: DataFrame, key: str, patterns: Sequence[str], idx: str = "sentence_idx") -> tuple[DataFrame, DataFrame]:
    """Sentences without blacklisted ones, renumbered, and the links of the sentences that stay, moved
    to the new numbers. One equi-join drops and moves links."""
    kept = sentences.where(~blacklisted(F.col("sentence"), patterns))
    numbered = renumbered(kept.withColumn("__old", F.col(idx)), key, idx)
    moves = numbered.select(key, F.col("__old").alias(idx), F.col(idx).alias("__new"))
    moved = links.join(moves, [key, idx]).withColumn(idx, F.col("__new")).drop("__new")
    return numbered.drop("__old"), moved


def affected_pages(sentences: DataFrame, key: str, patterns: Sequence[str]) -> DataFrame:
    """key, affected: whether any sentence of the page is blacklisted."""
    return sentences.groupBy(key).agg(F.bool_or(blacklisted(F.col("sentence"), patterns)).alias("affected"))


def length_changes(before: DataFrame, after: DataFrame, key: str, idx: str = "sentence_idx") -> DataFrame:
    """key, idx, n_before, n_after of the sentences of both tables whose length differs."""
    old = before.select(key, idx, F.length("sentence").cast("long").alias("n_before"))
    new = after.select(key, idx, F.length("sentence").cast("long").alias("n_after"))
    return old.join(new, [key, idx]).where("n_before != n_after")


def of_pages(rows: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The rows (links, captures, sentences) of the pages that are left."""
    return rows.join(pages.select(key), key, "left_semi")


def removed_pages(clustering: DataFrame, kept: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """The clustered pages that were not kept, with what is known about them (nulls where nothing is)."""
    return clustering.join(kept.select(key), key, "left_anti").join(pages, key, "left")


def with_text(pages: DataFrame, column: str = "text") -> DataFrame:
    """Pages whose text isn't null."""
    return pages.na.drop(subset=[column])


def whole_tokenizations(sentences: DataFrame, tokens: DataFrame, key: str, idx: str = "sentence_idx") -> DataFrame:
    """The sentences of pages of which every sentence has tokens and no token lies elsewhere."""
    seen = tokens.select(key, idx).distinct().withColumn("__tokens", F.lit(1))
    both = sentences.select(key, idx).withColumn("__sentence", F.lit(1)).join(seen, [key, idx], "full")
    broken = both.where("__tokens IS NULL OR __sentence IS NULL").select(key).distinct()
    return sentences.join(broken, key, "left_anti")


def with_segments(mentions: DataFrame, segments: DataFrame, key: str, first: str, last: str, idx: str = "sentence_idx") -> DataFrame:
    """Adds ``segment``, that of a mention's first sentence, and ``is_split``, whether its last sentence
    lies in another one. Sentences lie in one segment each, so two equi-joins do for an interval join."""
    begin = segments.select(key, F.col(idx).alias(first), "segment")
    end = segments.select(key, F.col(idx).alias(last), F.col("segment").alias("__last"))
    found = mentions.join(begin, [key, first]).join(end, [key, last])
    return found.withColumn("is_split", F.col("segment") != F.col("__last")).drop("__last")


def labelled_spans(candidates: DataFrame, gold: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Candidate spans with the gold label of exactly that span, 0 where there is none."""
    known = gold.groupBy(*keys).agg(F.max(label).alias(label))
    return candidates.join(known, list(keys), "left").withColumn(label, F.coalesce(label, F.lit(0)))


def of_validated_sentences(mentions: DataFrame, tokens: DataFrame, key: str, idx: str, validated: str) -> DataFrame:
    """Mentions in sentences that hold at least one validated token."""
    return mentions.join(tokens.where(F.col(validated)).select(key, idx).distinct(), [key, idx], "left_semi")


def without_singletons(mentions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mentions of clusters of two or more; counts are pre-aggregated, so large clusters stay spread."""
    several = mentions.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return mentions.join(several, list(keys), "left_semi")

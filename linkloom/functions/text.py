"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentences that a CSV reader would take for missing values.
NULL_LITERALS = ("nan", "null", "n/a", "na", "none", "<na>", "#n/a", "#na", "-nan", "-1.#ind", "1.#ind", "-1.#qnan", "1.#qnan")

LEADING, TRAILING = r"(?U)^\s+", r"(?U)\s+$"


def clean(text: Column) -> Column:
    """Control and format characters go; separators become one space each run.

    Repairing wrongly decoded text has no counterpart here and is left out."""
    return F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", ""), r"\p{Z}+", " ")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, LEADING, ""), TRAILING, "")


def leading_space(text: Column) -> Column:
    """How many characters stripping takes from the start."""
    return F.length(F.regexp_extract(text, r"(?U)^(\s*)", 1))


def starts_with_any(text: Column, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Whether one of the regular expressions matches at the start of text."""
    if not patterns:
        return F.lit(False)
    flag = "(?i)" if ignore_case else ""
    return text.rlike(f"{flag}^(?:{'|'.join(f'(?:{p})' for p in patterns)})")


def any_of(parts: Sequence[Column]) -> Column:
    """OR of conditions; false if there are none."""
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s]+"))


def is_headline(anchor: Column, max_title_words: int = 3, max_ratio: float = 0.6, min_words: int = 7) -> Column:
    """Title-case or capital headlines by the share of words that begin with a capital A-Z."""
    titled, words = F.regexp_count(anchor, F.lit(r"[A-Z][\p{L}\p{N}_]+")), word_count(anchor)
    return anchor.rlike(r"^\p{Lu}") & (words >= min_words) & (titled > max_title_words) & (titled / F.greatest(words, F.lit(1)) > max_ratio)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def highlighted(sentence: Column, start: Column, end: Column) -> Column:
    """The sentence with ``>>>`` and ``<<<`` around the characters from start to end (exclusive)."""
    return F.concat(F.substring(sentence, F.lit(1), start), F.lit(">>>"), F.substring(sentence, start + 1, end - start), F.lit("<<<"), F.substring(sentence, end + 1, F.length(sentence)))


def truncated(column: Column, most: int) -> Column:
    """The first ``most`` characters."""
    return F.left(column, F.lit(most))


def page_headline(date: Column, title: Column, body: Column) -> Column:
    """Date, title and text of a page in one line, for reading."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(": "), title, F.lit(" ------- "), body)


def doc_topic(doc_id: Column) -> tuple[Column, Column]:
    """Topic and subtopic of a document id such as ``12_7ecb`` (12, 12_0) or ``12_7ecbplus`` (12, 12_plus)."""
    parts = F.split(doc_id, "_")
    plus = F.coalesce(F.endswith(F.get(parts, F.lit(1)), F.lit("plus")), F.lit(False))
    return F.get(parts, F.lit(0)), F.concat(F.get(parts, F.lit(0)), F.when(plus, "_plus").otherwise("_0"))


def conll_topic(doc_id: Column) -> tuple[Column, Column]:
    """Topic, and the topic with 1 where the id has ``plus`` in it, else with 0."""
    topic = F.split_part(doc_id, F.lit("_"), F.lit(1))
    return topic, F.concat(topic, F.when(F.contains(doc_id, F.lit("plus")), "_1").otherwise("_0"))


def map_hash(settings: Column) -> Column:
    """Eight digits that name a map of strings, whatever the order of its keys; null values count."""
    entries = F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.to_json(F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("")).alias("v"), e["value"].isNull().alias("n"))))
    return short_hash(F.concat_ws("\n", entries))


def with_deviation(mean: Column, deviation: Column, decimals: int) -> Column:
    """``mean+-deviation`` with fixed decimals, a missing deviation being 0."""
    shown = lambda c: F.format_string(f"%.{decimals}f", F.round(c, decimals))
    return F.concat(shown(mean), F.lit("+-"), shown(F.coalesce(deviation, F.lit(0.0))))


def moment(written: Column) -> Column:
    """The timestamp of a date with a zone, ISO 8601 or as in mail headers; null where unreadable.
    Without a zone the session's holds."""
    bare = F.regexp_replace(F.trim(written), r"^\p{L}+, *", "")
    formats = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z"]
    return F.coalesce(bare.try_cast("timestamp"), *[F.try_to_timestamp(bare, F.lit(f)) for f in formats])


def gold_subtopic(doc_id: Column) -> Column:
    """Topic and first document part of an id: ``12_7ecb`` of ``12_7ecb_3``."""
    return F.substring_index(doc_id, "_", 2)

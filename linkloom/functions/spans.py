"""Character and token span functions on columns. Ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that belong to a word's edge besides letters and digits.
EDGE_CHARACTERS = "“‘'\"”’`´$€£#%*+@&"
WANTED = "[0-9A-Za-z" + EDGE_CHARACTERS.replace("$", "\\$").replace("&", "\\&") + "]"
UNWANTED = WANTED.replace("[", "[^", 1)
# Runs at an end are anchored by \z: in Java $ also matches before a last line break.


def clamped(start: Column, end: Column, spans: Column) -> Column:
    """struct(idx, start, end): a text span inside the first of the ordered spans (start, end) that ends
    after the span's start, else inside the last, cut to it and relative to it."""
    idx = F.least(F.size(F.filter(spans, lambda s: s["end"] <= start)), F.size(spans) - 1)
    span = F.get(spans, idx)
    return F.struct(idx.alias("idx"), F.greatest(start - span["start"], F.lit(0)).alias("start"), (F.least(end, span["end"]) - span["start"]).alias("end"))


def harmonized_start(sentence: Column, idx: Column) -> Column:
    """Moves a span's start out to its word's first character, or in to the next word's."""
    char = F.substring(sentence, idx + 1, F.lit(1))
    run_before = F.length(F.regexp_extract(F.substring(sentence, F.lit(2), idx - 1), f"({WANTED}*)\\z", 1))
    run_unwanted = F.length(F.regexp_extract(F.substring(sentence, idx + 1, F.length(sentence)), f"^({UNWANTED}*)", 1))
    inward = F.least(idx + run_unwanted, F.length(sentence) - 1)
    return F.when(char.rlike(WANTED), F.when(idx >= 1, idx - run_before).otherwise(F.lit(0))).otherwise(inward)


def harmonized_end(sentence: Column, idx: Column) -> Column:
    """Moves a span's exclusive end out to its word's end, or in to the previous word's."""
    e = idx - 1
    char = F.substring(sentence, e + 1, F.lit(1))
    run_after = F.length(F.regexp_extract(F.substring(sentence, e + 2, F.length(sentence)), f"^({WANTED}*)", 1))
    run_unwanted = F.length(F.regexp_extract(F.substring(sentence, F.lit(1), e + 1), f"({UNWANTED}*)\\z", 1))
    inward = F.when(e <= 1, e).otherwise(F.greatest(e - run_unwanted, F.lit(1)))
    return F.when(char.rlike(WANTED), e + run_after).otherwise(inward) + 1


def enumerated(first: Column, last: Column, max_width: int) -> Column:
    """array of (start, end) of all spans of at most max_width tokens between first and last, both inclusive."""
    starts = F.sequence(first, last)
    return F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(s, F.least(s + (max_width - 1), last)), lambda e: F.struct(s.alias("start"), e.alias("end")))))

"""Licence detection with a positional index of rare tokens.

Templates are word sequences with a mandatory key phrase. From each template only its rarest words
are indexed: the ones with the highest IDF in the scanned corpus, each with its position in the
template. A file's occurrences of indexed words are looked up; a posting says "template t would
start at file position - template position". Starts on which at least two of the template's indexed
words agree are candidates, and a candidate counts only if the template's key phrase stands at its
place there. Phrases whose every place is counted (the base phrases) are templates that are key
phrases as a whole, so their places come out exactly.

Native: the scan is one projection over the rows without any shuffle; the corpus statistic is one
pre-aggregated count per template word. Whatever travels to the tasks depends on the templates
alone, so hot sources and copies need no special care. Votes are counted by sorting them, so a very
long file costs what its length costs (times the logarithm of its hits), also if it repeats one
phrase only.

Null and empty texts have no words, no labels and score 0. Rows come back one for one (repeated
rows too) and an empty table gives an empty result; ties of IDF go to the alphabetically first word;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words once A-Z are lower-cased: ASCII but for digits and a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str
    base: bool = False

    @property
    def sequence(self) -> list[str]:
        return self.words.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase begins in the template."""
        words, key = self.sequence, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


BASE = (
    Template("mit", "mit license", "mit license", True),
    Template("apache", "apache license", "apache license", True),
    Template("gpl", "general public license", "general public license", True),
)
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("gpl", "it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("gpl", "licensed under the gnu gpl", "gnu gpl"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    Template("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)
TEMPLATES = BASE + NOTICES
#: Indexed words of a template, and how many of them must agree on a start.
INDEXED, AGREE = 3, 2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS), "")


def document_frequency(files: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each template word occurs; one partial count per word and task moves."""
    held = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counted = files.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {word: n for word, n in counted.collect()}


def index(templates: tuple[Template, ...], df: dict[str, int]) -> list[list[tuple[str, int]]]:
    """Each template's rarest words with their first position in it."""
    chosen = []
    for t in templates:
        rarest = sorted(set(t.sequence), key=lambda w: (df.get(w, 0), w))[:INDEXED]
        chosen.append([(w, t.sequence.index(w)) for w in rarest])
    return chosen


def scan_licenses(files: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """keys, n_words, n_base (places of base phrases), first_word, last_word, base_labels, labels
    (sorted, comma-joined, empty if none), score (best share of a found template's words that stand
    at their places) and places (array of label and start, in words from 0)."""
    vocabulary = sorted({w for t in templates for w in t.sequence})
    postings = index(templates, document_frequency(files, text, vocabulary))
    rare = sorted({w for chosen in postings for w, _ in chosen})

    rows = files.select(*keys, words_of(F.col(text)).alias("words"))
    n = F.size("words")
    at_rare = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", i).isin(rare))
    rows = rows.withColumn("at", F.when(n > 0, at_rare).otherwise(F.array().cast("array<int>")))
    # From here on only the few rows and positions with an indexed word cost anything.
    rows = rows.withColumn("hits", F.transform("at", lambda i: F.struct(i.alias("i"), F.get("words", i).alias("w"))))
    nowhere = F.array().cast("array<int>")

    def starts(t: Template, chosen: list[tuple[str, int]]) -> Column:
        def votes_of(word: str, position: int) -> Column:
            return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"] - F.lit(position))

        votes = F.sort_array(F.concat(*[votes_of(*posting) for posting in chosen]))
        need = min(AGREE, len(chosen))
        # A word votes once for a start: where one is as good as the vote `need - 1` places on, so many agree.
        agreed = F.zip_with(votes, F.slice(votes, need, F.greatest(F.size(votes), F.lit(1))), lambda x, y: F.when(x == y, x))
        agreed = F.array_distinct(F.filter(agreed, lambda o: o.isNotNull()))
        key, begin = t.key.split(), t.key_at
        there = lambda o: (o + begin >= 0) & (o + (begin + len(key)) <= F.size("words")) & reduce(
            lambda a, b: a & b, (F.get("words", o + (begin + j)) == w for j, w in enumerate(key))
        )
        return F.when(F.size("hits") >= need, F.filter(agreed, there)).otherwise(nowhere)

    rows = rows.select(*keys, "words", n.cast("long").alias("n_words"), *[starts(t, c).alias(f"s{k}") for k, (t, c) in enumerate(zip(templates, postings))])

    def matched(t: Template, k: int) -> Column:
        """The best share of the template's words that stand where a found start puts them."""
        share = lambda o: reduce(
            lambda a, b: a + b, (F.when((o + j >= 0) & (F.get("words", F.greatest(o + j, F.lit(0))) == w), 1.0).otherwise(0.0) for j, w in enumerate(t.sequence))
        ) / F.lit(float(len(t.sequence)))
        return F.when(F.size(f"s{k}") > 0, F.array_max(F.transform(f"s{k}", share))).otherwise(F.lit(0.0))

    base = [k for k, t in enumerate(templates) if t.base]
    all_base = F.concat(*[F.col(f"s{k}") for k in base])

    def labels(of: list[int]) -> Column:
        held = F.array(*[F.when(F.size(f"s{k}") > 0, F.lit(templates[k].label)) for k in of])
        return F.array_join(F.array_sort(F.array_distinct(F.filter(held, lambda x: x.isNotNull()))), ",")

    def labelled(k: int, t: Template) -> Column:
        return F.transform(f"s{k}", lambda o: F.struct(F.lit(t.label).alias("label"), o.cast("long").alias("start")))

    places = F.concat(*[labelled(k, t) for k, t in enumerate(templates)])
    return rows.select(
        *keys,
        "n_words",
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(list(range(len(templates)))).alias("labels"),
        F.greatest(*[matched(t, k) for k, t in enumerate(templates)]).alias("score"),
        places.alias("places"),
    )

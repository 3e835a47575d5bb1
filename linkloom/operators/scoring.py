"""Coreference scores of CoNLL tokens in one call: chains are read, filtered, identified and compared.

A mention is known by its span, or by its minimum span: the set of the runs of words, with the places where
their phrases close, that its parse leaves (all its words, numbered, if none counts). The set is written out
in one order, so that two mentions are equal exactly if their texts are. Parses are those of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import coref, metrics, parses
from linkloom.operators.materialize import materialized, saved

MENTION = ("doc", "start", "end", "cluster")


def chains(tokens: DataFrame, keep_singletons: bool = True) -> DataFrame:
    """doc, start, end, cluster, sentence of the chains of tokens (doc, sentence, token, coref)."""
    found = coref.read_mentions(tokens, "doc", "token", "coref", "sentence").select(*MENTION, "sentence")
    # Mentions of a span lie together, as those that are identified by it have to.
    found = found.repartition("doc", "start", "end").distinct()
    if not keep_singletons:
        found = found.join(found.groupBy("doc", "cluster").agg(F.count("*").alias("n")).where("n > 1").select("doc", "cluster"), ["doc", "cluster"], "left_semi")
    return found


def without_nested(mentions: DataFrame, keep_singletons: bool = True) -> DataFrame:
    """Mentions that lie in no other of their chain. A chain of which one mention would be left stays whole, or
    goes as a whole without singletons; chains of one stay."""
    rows = mentions.withColumns({"__chain": F.struct("doc", "cluster"), "__key": F.struct("start", "end")})
    outer = materialized(coref.without_nested(rows, "__chain", "start", "end", "__key"))
    both = mentions.groupBy("doc", "cluster").agg(F.count("*").alias("all")).join(outer.groupBy("doc", "cluster").agg(F.count("*").alias("left")), ["doc", "cluster"])
    single = both.where("left = 1 AND all > 1").select("doc", "cluster")
    kept = outer.drop("__chain", "__key").join(single, ["doc", "cluster"], "left_anti")
    return kept.unionByName(mentions.join(single, ["doc", "cluster"], "left_semi")) if keep_singletons else kept


def identified(mentions: DataFrame) -> DataFrame:
    """doc, mention, cluster: each span, or minimum span (column spans), once for each document; of several
    chains that claim it the least has it. Where sides are told apart (column __side), for each."""
    side = [c for c in mentions.columns if c == "__side"]
    if "spans" not in mentions.columns:
        return mentions.groupBy("doc", "start", "end", *side).agg(F.min("cluster").alias("cluster")).select("doc", F.concat_ws(":", "start", "end").alias("mention"), "cluster", *side)
    by_place = F.sort_array(F.transform("spans", lambda s: F.struct(s["at"].alias("at"), s["words"].alias("words"))))
    name = F.to_json(F.struct("sentence", F.array_distinct(by_place).alias("spans")))
    return mentions.select("doc", name.alias("mention"), "cluster", *side).groupBy("doc", "mention", *side).agg(F.min("cluster").alias("cluster")).select("doc", "mention", "cluster", *side)


def parsed(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """mentions with root and spans by the parses of the words."""
    keyed = mentions.withColumn("__key", F.concat_ws(":", "start", "end", "cluster", "__side"))
    return parses.with_minimum_spans(keyed, words, "doc", "token", "__key").drop("__key")


def clusterings(key: DataFrame, system: DataFrame, min_spans: bool = False, keep_singletons: bool = True, noun_phrases: bool = False, nested: bool = True, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """doc, mention, cluster of the key's and the system's tokens, over the key's documents.

    noun_phrases drops verb phrases by the parses, ``nested=False`` mentions inside others of their chain. words: the
    key's tokens as `parses.token_runs` has them, if they are there already."""
    known = (key if words is None else words).select("doc").distinct()
    found = []
    for side, tokens in enumerate((key, system)):
        marked = tokens.where(~F.col("coref").isin("-", "_", ""))
        marked = saved((marked.join(known, "doc", "left_semi") if side else marked).select("doc", "sentence", "token", "coref"))
        found.append(chains(marked, keep_singletons).withColumn("__side", F.lit(side)))
    if min_spans or noun_phrases:
        # Both sides meet the words at once, so that words are shuffled once.
        both = parsed(found[0].unionByName(found[1]), parses.token_runs(key, "doc", "token") if words is None else words)
        if noun_phrases:
            both = parses.without_verb_phrases(saved(both), ["__side", "doc", "cluster"])
        both = both if min_spans else both.select(*MENTION, "sentence", "__side")
        both = saved(identified(both) if nested else both)
        found = [both.where(F.col("__side") == side) for side in (0, 1)]
    if not nested:
        found = [identified(without_nested(materialized(f), keep_singletons)) for f in found]
    elif not (min_spans or noun_phrases):
        found = [identified(f) for f in found]
    return tuple(saved(f.select("doc", "mention", "cluster")) for f in found)


def conll_scores(key: DataFrame, system: DataFrame, names: Sequence[str] = metrics.METRICS, **options: bool | DataFrame) -> DataFrame:
    """metric, precision, recall, f1 of a system's CoNLL tokens against the key's: doc, sentence, token, coref,
    and word, pos, parse of the key where parses are asked for. Options as for `clusterings`."""
    return metrics.report(*clusterings(key, system, **options), names)


def of_files(rows: DataFrame, word: int = 3, pos: int = 4, parse: int = 5) -> DataFrame:
    """doc, sentence, token, word, pos, parse, coref (the last column) of ``read_conll`` rows; columns that are
    missing are null."""
    get = lambda k: F.get("columns", F.lit(k))
    named = {"word": get(word), "pos": get(pos), "parse": get(parse), "coref": F.element_at("columns", -1)}
    return rows.select(F.col("document").alias("doc"), "sentence", F.col("token_id").alias("token"), *[c.alias(n) for n, c in named.items()])

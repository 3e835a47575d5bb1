"""Mentions, pairs, CoNLL text and corpus splits for cross-document coreference."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text
from linkloom.operators import sampling
from linkloom.operators.materialize import materialized, saved
from linkloom.operators.sentences import CHUNK


#: Mentions of a block, of which two of a topic meet in one task; larger topics have blocks of up to ``LARGEST``
#: mentions before they have more than ``BLOCKS``.
BLOCK, BLOCKS, LARGEST = 1024, 16, 32_768
#: Pairs that leave a task at a time.
PAIRS = 1_000_000
#: Sentences of a topic that are kept in one partition, so that its scores are counted there.
TOGETHER = 256


def blocks(size: Column) -> Column:
    """The number of blocks of a topic: bounded until blocks are at their largest, so that the copies of a mention
    that meet other blocks grow no faster than the mentions."""
    return F.least(1 + F.floor(size / BLOCK), F.greatest(F.lit(BLOCKS), F.ceil(size / LARGEST))).cast("int")


def cells(mentions: DataFrame, topic: str, *columns: Column) -> DataFrame:
    """The mentions, each once for every block of its topic: topic, i, j (the two blocks that meet), block and
    the columns. However large a topic is, a cell holds two blocks."""
    sizes = mentions.groupBy(topic).agg(blocks(F.count("*")).alias("__blocks"))
    dealt = mentions.join(sizes.withColumnRenamed(topic, "__topic"), F.col(topic).eqNullSafe(F.col("__topic"))).select(topic, *columns, "__blocks", F.pmod(F.xxhash64(*columns[:1]), F.col("__blocks")).cast("int").alias("block"))
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__other"))
    return other.select(topic, F.least("block", "__other").alias("i"), F.greatest("block", "__other").alias("j"), "block", *[c for c in dealt.columns if c not in (topic, "__blocks", "block")])


def mention_pairs(mentions: DataFrame, topic: str, key: str) -> DataFrame:
    """topic, a, b: all pairs of a topic's mentions, which is what pair scoring takes. Blocks of a topic meet
    under a key of their own."""
    rows = cells(mentions, topic, F.col(key).alias("key"))
    a, b = (rows.select(topic, "i", "j", F.col("block").alias(f"__{n}"), F.col("key").alias(n)) for n in "ab")
    both = a.join(b.withColumnRenamed(topic, "__topic"), (a["i"] == b["i"]) & (a["j"] == b["j"]) & a[topic].eqNullSafe(F.col("__topic")))
    # Of two blocks each pair once; a block with itself holds its own pairs.
    return both.where((F.col("a") < F.col("b")) & ((a["i"] == a["j"]) | (F.col("__a") != F.col("__b")))).select(topic, "a", "b")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_sides(cell: pa.Table) -> list[tuple[pa.Array, np.ndarray]]:
    """The keys and unit vectors (NaN for zero ones) of a cell's two blocks, or of its one."""
    block = cell.column("block").to_numpy()
    out = []
    for k in dict.fromkeys((cell.column("i")[0].as_py(), cell.column("j")[0].as_py())):
        side = cell.filter(pa.array(block == k))
        x = side.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(side), -1) if len(side) else np.zeros((0, 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append((side.column("key").combine_chunks(), x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def scored_pairs(mentions: DataFrame, topic: str, key: str, vector: str) -> DataFrame:
    """topic, a, b, score (cosine), probability (its sigmoid) of all pairs of a topic: matrix products for each two
    blocks of it, whose pairs leave some rows at a time. Vectors of a topic have one length; a zero vector's
    scores are null."""
    rows = cells(mentions, topic, F.col(key).alias("key"), F.col(vector).alias("v"))
    kinds = mentions.select(topic, key).schema
    schema = f"topic {kinds[0].dataType.simpleString()}, a {kinds[1].dataType.simpleString()}, b {kinds[1].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches))
        sides = unit_sides(cell)
        (left, x), (right, y) = sides[0], sides[-1]
        step = max(1, PAIRS // max(1, len(y)))
        for start in range(0, len(x) if len(y) else 0, step):
            dot = x[start : start + step] @ y.T
            # A block with itself holds each of its pairs once.
            at = np.nonzero(np.arange(len(y)) > np.arange(start, start + len(dot))[:, None]) if len(sides) == 1 else tuple(i.ravel() for i in np.indices(dot.shape))
            a, b, score = left.take(pa.array(at[0] + start)), right.take(pa.array(at[1])), dot[at]
            swap = pc.greater(a, b)
            a, b = pc.if_else(swap, b, a), pc.if_else(swap, a, b)
            out = {"topic": pa.repeat(cell.column(topic)[0], len(a)), "a": a, "b": b, "score": pa.array(score, mask=np.isnan(score))}
            yield pa.RecordBatch.from_pydict(out).filter(pc.less(a, b))

    found = rows.groupBy(topic, "i", "j").applyInArrow(run, schema)
    return found.withColumnRenamed("topic", topic).withColumn("probability", 1 / (1 + F.exp(-F.col("score"))))


def positive_pairs(mentions: DataFrame, cluster: str, key: str) -> DataFrame:
    """a, b: pairs within clusters, at most ``int(6 * sqrt(n))`` of each, chosen by a digest of the pair.

    Each mention is paired only with those that follow it at distances up to the cap, so that large
    clusters never expand into all their pairs."""
    n = F.count("*").over(Window.partitionBy(cluster))
    rows = mentions.select(cluster, key).withColumn("n", n).withColumn("i", F.row_number().over(Window.partitionBy(cluster).orderBy(F.md5(F.col(key).cast("string")), key)))
    cap = F.least(F.floor(6 * F.sqrt("n")), F.expr("n * (n - 1) div 2"))
    # Pairs in the order (distance, first place): the first cap of them, which 2 * cap / n distances hold.
    reach = F.ceil(2 * F.col("cap") / F.col("n"))
    steps = rows.where("n > 1").withColumn("cap", cap).select(cluster, F.col(key).alias("a"), "i", "n", "cap", F.explode(F.sequence(F.lit(1).cast("long"), F.least(reach, F.col("n") - 1))).alias("d")).withColumn("j", F.col("i") + F.col("d")).where("j <= n")
    place = (F.col("d") - 1) * F.col("n") - F.expr("d * (d - 1) div 2") + F.col("i")
    return steps.where(place <= F.col("cap")).join(rows.select(cluster, F.col("i").alias("j"), F.col(key).alias("b")), [cluster, "j"]).select(cluster, "a", "b")


def with_singleton_flag(mentions: DataFrame, cluster: str) -> DataFrame:
    return mentions.join(mentions.groupBy(cluster).agg((F.count("*") == 1).alias("singleton")), cluster)


def without_nested(mentions: DataFrame, doc: str, start: str, end: str, key: str) -> DataFrame:
    """Mentions that lie in no other mention of the document; of equal spans the least key stays.

    A sweep: with mentions by start, then by falling end, then by key, one lies in another exactly if
    one before it in its document ends as late. So the running maximum of ends decides, over range
    partitions, and neither widths nor the size of a document multiply anything."""
    rows = mentions.withColumns({"__back": -F.col(end), "__end": F.struct(F.col(doc).alias("d"), F.col(end).alias("e"))})
    swept = sampling.running_max(rows, "__end", doc, start, "__back", key)
    inside = (F.col("highest.d").eqNullSafe(F.col(doc))) & (F.col("highest.e") >= F.col(end))
    return swept.where(~F.coalesce(inside, F.lit(False))).select(*mentions.columns)


def top_spans(tokens: DataFrame, topic: str, sentence: str, token: str, score: Column, max_width: int = 10, share: float = 0.25) -> DataFrame:
    """topic, sentence, start, end, score: the ``int(share * tokens)`` best candidate spans of each topic.
    Ties go to earlier sentences, starts and ends. ``sampling.best`` selects them, so no topic is ranked."""
    # Sentences are kept, neighbouring ones of a topic together; their candidates are made anew whenever they are read.
    bounds = tokens.groupBy(topic, sentence).agg(F.min(token).alias("lo"), F.max(token).alias("hi"), F.count("*").alias("n"))
    bounds = materialized(bounds.repartition(topic, F.floor(F.col(sentence) / TOGETHER)))
    # Spans are rows from the start, not arrays of a sentence's, which take several times as long to make.
    ends = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (max_width - 1), F.col("hi")))).alias("end")

    def made(df: DataFrame) -> DataFrame:
        kept = [c for c in df.columns if c.startswith("__")]
        starts = df.select(topic, sentence, "hi", F.explode(F.sequence("lo", "hi")).alias("start"), *kept)
        return starts.select(topic, sentence, "start", ends, *kept).withColumn("score", score)

    limit = bounds.groupBy(topic).agg(F.floor(F.sum("n") * share).alias("k"))
    return sampling.best(bounds, limit, topic, "score", sentence, "start", "end", expand=made).select(topic, sentence, "start", "end", "score")


def conll_column(tokens: DataFrame, mentions: DataFrame, doc: str, token: str) -> DataFrame:
    """tokens with ``coref``: single-token mentions ``(c)``, then starts ``(c``, then ends ``c)``, joined by
    ``|``, ``-`` where there are none. Starts and ends are ordered by the other end, descending.

    mentions: doc, start, end (inclusive token numbers), cluster."""
    joined = mention_marks(mentions, doc, token).groupBy(doc, token).agg(joined_marks().alias("coref"))
    return tokens.join(joined, [doc, token], "left").withColumn("coref", F.coalesce("coref", F.lit("-")))


def joined_marks() -> Column:
    """The marks of a token as its column has them."""
    return F.array_join(F.sort_array(F.collect_list(F.struct("kind", "o", "t")))["t"], "|")


def mention_marks(mentions: DataFrame, doc: str, token: str) -> DataFrame:
    """doc, token, kind, o (what marks of a token are ordered by), t (the mark)."""
    m = mentions.select(doc, "start", "end", F.col("cluster").cast("string").alias("c"))
    at = lambda col, kind, other, text, cond: m.where(cond).select(doc, F.col(col).alias(token), F.lit(kind).alias("kind"), (-F.col(other)).alias("o"), text.alias("t"))
    wide = F.col("start") != F.col("end")
    marks = at("start", 0, "end", F.concat(F.lit("("), "c", F.lit(")")), ~wide)
    marks = marks.unionByName(at("start", 1, "end", F.concat(F.lit("("), "c"), wide)).unionByName(at("end", 2, "start", F.concat("c", F.lit(")")), wide))
    return marks


def conll_chunks(chunks: DataFrame, mentions: DataFrame, doc: str) -> DataFrame:
    """doc, sentence, token, word, total, coref of the tokens of chunks (`sentences.token_chunks`), marked as by
    `conll_column`. Marks meet chunks instead of tokens, so tokens are rows only after the join."""
    marks = mention_marks(mentions, doc, "token").select(doc, F.floor(F.col("token") / CHUNK).alias("chunk"), F.pmod("token", F.lit(CHUNK)).cast("int").alias("at"), "kind", "o", "t")
    # One shuffle: what lies together by document and chunk does so by token, too.
    each = marks.repartition(doc, "chunk").groupBy(doc, "chunk", "at").agg(joined_marks().alias("coref"))
    marked = each.groupBy(doc, "chunk").agg(F.map_from_entries(F.collect_list(F.struct("at", "coref"))).alias("__marks"))
    rows = chunks.join(marked, [doc, "chunk"], "left").select(doc, "chunk", "total", "tokens", "__marks", F.posexplode("sentences").alias("at", "sentence"))
    mark = F.coalesce(F.try_element_at("__marks", F.col("at")), F.lit("-"))
    return rows.select(doc, F.col("sentence").cast("long").alias("sentence"), (F.col("chunk") * CHUNK + F.col("at")).alias("token"), F.get("tokens", F.col("at")).alias("word"), "total", mark.alias("coref"))


def chain_marks(tokens: DataFrame, doc: str, token: str, coref: str, *keep: str) -> DataFrame:
    """doc, token, chain, opens, closes of the marks in a token column: ``(c``, ``c)`` and ``(c)``, joined by ``|``."""
    part = F.explode(F.split(F.coalesce(coref, F.lit("")), r"\|")).alias("part")
    marks = tokens.where(~F.col(coref).isin("-", "_", "")).select(doc, F.col(token).cast("long").alias("token"), *keep, part).where(~F.col("part").isin("-", "_", ""))
    return marks.select(doc, "token", *keep, F.translate("part", "()", "").alias("chain"), F.col("part").startswith("(").alias("opens"), F.col("part").endswith(")").alias("closes")).where("chain != ''")


def matched_brackets(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """rows (doc, chain, token, opens, more), in order, with the end of each start that has one, and starts and ends that
    have none (end is null), but for the starts that are left in the last chain; and those. Of a chain's brackets of one
    depth starts and ends alternate, so a start's end is the next one of its depth."""
    code = [rows.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in (0, 1)]
    group = np.cumsum(np.r_[False, (np.diff(code[0]) != 0) | (np.diff(code[1]) != 0)])
    opens = rows.column(3).to_numpy(zero_copy_only=False).astype(bool)
    depth = np.cumsum(np.where(opens, 1, -1)) + ~opens
    order = np.lexsort((depth, group))
    a, b = order[:-1], order[1:]
    met = (group[a] == group[b]) & (depth[a] == depth[b]) & opens[a] & ~opens[b]
    start, end = a[met], b[met]
    left = np.ones(len(opens), bool)
    left[start] = left[end] = False
    open_ = left & opens & (group == group[-1])
    lone = np.flatnonzero(left & ~open_)
    ends = pa.concat_arrays([rows.column(2).take(pa.array(end)).cast(pa.int64()), pa.nulls(len(lone), pa.int64())])
    return rows.take(pa.array(np.r_[start, lone])).append_column("end", ends), rows.filter(pa.array(open_))


def nearest(steps: DataFrame, doc: str, *keep: str) -> DataFrame:
    """doc, chain, token, opens, end, keep: a mention for every start whose end lies in the same range partition, and the
    brackets that are left (end is null). What a partition leaves of a chain are ends and then starts, so the chain's
    other mentions are those of what its partitions left."""
    rows = steps.select(doc, "chain", "token", "opens", *keep)
    schema = rows.schema.add("end", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the starts that are open in the chain that the batches so far end with
        for batch in batches:
            if batch.num_rows:
                pairs, held = matched_brackets(batch if held is None else pa.concat_batches([held, batch]))
                yield pairs
        if held is not None:
            yield held.append_column("end", pa.nulls(held.num_rows, pa.int64()))

    order = [doc, "chain", "token", F.desc("opens")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def read_mentions(tokens: DataFrame, doc: str, token: str, coref: str, *keep: str) -> DataFrame:
    """doc, start, end, cluster of the bracketed chains of a token column, with other columns of its first token. In a
    chain an end closes what was opened last; at one token, starts come before ends.

    Brackets are matched within range partitions, and what is left there by its depth in the chain, a running sum over
    range partitions, so one document or chain may hold all rows: of a chain's brackets of one depth, starts and ends
    alternate, so numbered in that order every two of them are a mention. A chain with an end too many or too few raises."""
    marks = chain_marks(tokens, doc, token, coref, *keep)
    single = marks.where("opens AND closes").select(doc, F.col("token").alias("start"), F.col("token").alias("end"), F.col("chain").alias("cluster"), *keep)
    near = saved(nearest(marks.where("opens != closes"), doc, *keep))
    found = single.unionByName(near.where("end IS NOT NULL").select(doc, F.col("token").alias("start"), "end", F.col("chain").alias("cluster"), *keep))
    rest = near.where("end IS NULL")
    if rest.isEmpty():
        return found
    steps = rest.withColumn("step", F.when(F.col("opens"), 1).otherwise(-1))
    # Equal marks of one token are interchangeable; their number parts them.
    order = [doc, "chain", "token", "last", "nth"]
    steps = steps.withColumn("last", ~F.col("opens")).withColumn("nth", F.monotonically_increasing_id())
    deep = sampling.running_sum(steps, "step", *order).withColumn("depth", F.when(F.col("opens"), F.col("before") + 1).otherwise(F.col("before")))
    deep = materialized(deep.select(doc, "chain", "token", "last", "nth", "step", "depth", *keep))
    wrong = deep.groupBy(doc, "chain").agg(F.sum("step").alias("left"), F.min("depth").alias("least")).where("left != 0 OR least < 1").limit(1).collect()
    if wrong:
        raise ValueError(f"chain {wrong[0].chain} of {wrong[0][0]}: its starts and ends don't match")
    rows = sampling.placed(deep, doc, "chain", "depth", "token", "last", "nth")
    pairs = rows.groupBy(F.floor(F.col("place") / 2).alias("pair")).agg(F.min_by(F.struct(doc, "chain", "token", *keep), "place").alias("s"), F.max("token").alias("end"))
    return found.unionByName(pairs.select(f"s.{doc}", F.col("s.token").alias("start"), "end", F.col("s.chain").alias("cluster"), *[f"s.{c}" for c in keep]))


def masked_tokens(tokens: DataFrame, order: list[str], sentence: str, token: str, partition: str) -> DataFrame:
    """tokens with all but the first of each run of one sentence number replaced by ``___``.

    Runs are of neighbouring rows: a document that starts with its predecessor's last number is masked
    too when both are in one partition."""
    before = F.lag(sentence).over(Window.partitionBy(partition).orderBy(*order))
    return tokens.withColumn(token, F.when(before == F.col(sentence), F.lit("___")).otherwise(F.col(token)))


def fractions(shares: Mapping[str, float]) -> dict[str, float]:
    """Shares scaled to sum to 1."""
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()}


def assign_splits(links: DataFrame, src: str, dst: str, shares: Mapping[str, float]) -> DataFrame:
    """src, split: targets in digest order fill the splits up to their shares of links, small splits
    first; a page belongs to the first split in that order that one of its targets is in."""
    parts = sorted(fractions(shares).items(), key=lambda x: (x[1], x[0]))
    events = links.groupBy(dst).agg(F.count("*").alias("n")).withColumn("order", F.md5(F.col(dst).cast("string")))
    # Running sums by the digest's first three digits first, so that no task ranks all targets.
    events = events.withColumn("bin", F.substring("order", 1, 3))
    bins = events.groupBy("bin").agg(F.sum("n").alias("in_bin"))
    upto = bins.withColumn("before", F.coalesce(F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = F.sum("in_bin").over(Window.partitionBy(F.lit(0)))
    ranked = events.join(F.broadcast(upto.withColumn("total", total).select("bin", "before", "total")), "bin")
    cum = F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("order", dst).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("share", cum / F.col("total"))
    bound, split = 0.0, F.lit(len(parts) - 1)
    for k in reversed(range(len(parts) - 1)):
        bound = sum(v for _, v in parts[: k + 1])
        split = F.when(F.col("share") <= bound, k).otherwise(split)
    numbers = links.join(ranked.select(dst, split.alias("k")), dst).groupBy(src).agg(F.min("k").alias("k"))
    return numbers.select(src, F.element_at(F.array(*[F.lit(name) for name, _ in parts]), F.col("k") + 1).alias("split"))


def within_one_split(links: DataFrame, splits: DataFrame, src: str, dst: str) -> DataFrame:
    """Links to targets all of whose sources are in the same split, with that split."""
    joined = links.join(splits, src)
    crossing = joined.groupBy(dst).agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x != y").select(dst)
    return joined.join(crossing, dst, "left_anti")


def hyperedges(links: DataFrame, src: str, dst: str) -> DataFrame:
    """dst, pins (its distinct sources), weight (its links) of every target."""
    return links.groupBy(dst).agg(F.array_sort(F.collect_set(src)).alias("pins"), F.count("*").alias("weight"))


def pins(links: DataFrame, src: str, dst: str) -> DataFrame:
    """dst, src, links (of that source to that target), place: every pin of every hyperedge as a row of its own, with
    where it stands in the list of all pins, hyperedges in order of dst, pins of src."""
    rows = links.groupBy(dst, src).agg(F.count("*").alias("links"))
    return sampling.placed(rows, dst, src)


def hyperedge_offsets(links: DataFrame, src: str, dst: str) -> DataFrame:
    """dst, start, end of each hyperedge's pins in the list of all pins, hyperedges in order of dst: running sums
    of numbers of different sources, so no hyperedge is gathered."""
    sized = links.select(dst, src).distinct().groupBy(dst).agg(F.count("*").alias("n"))
    return sampling.running_sum(sized, "n", dst).select(dst, F.col("before").alias("start"), (F.col("before") + F.col("n")).alias("end"))


def conll_rows(tokens: DataFrame, mentions: DataFrame, doc: str, token: str, validated: str) -> DataFrame:
    """The validated tokens with topic, subtopic (1 for a second collection, else 0) and ``coref``."""
    topic, subtopic = text.conll_topic(F.col(doc))
    return conll_column(tokens.where(F.col(validated)).withColumns({"topic": topic, "subtopic": subtopic}), mentions, doc, token)
